import json

import pytest
from pyspark.sql import functions as F

from stylematch.plans import outfits
from stylematch.session import scratch_path
from stylematch.sources.delimited import BOM, column_named, file_encodings, find_encoding, read_delimited, tidy_header, write_delimited
from stylematch.sources.outfit_labels import read_label_documents
from stylematch.streaming import ratings


def test_encodings_are_found(spark, tmp_path):
    for encoding, found in (("cp949", "cp949"), ("utf-8", "utf-8"), ("utf-8-sig", "utf-8")):
        path = tmp_path / f"{encoding}.csv"
        path.write_bytes('color ,rgb_tuple\n화이트,"(255, 255, 255)"\n블랙,"(0, 0, 0)"\n'.encode(encoding))
        assert find_encoding(spark, str(path)) == found
        rows = read_delimited(spark, str(path), None).collect()
        assert [tuple(r) for r in rows] == [("화이트", "(255, 255, 255)"), ("블랙", "(0, 0, 0)")]
        assert rows[0].__fields__ == ["color", "rgb_tuple"]


def test_each_file_of_a_folder_has_its_own_encoding(spark, tmp_path):
    for name, encoding, word in (("a", "cp949", "화이트"), ("b", "utf-8", "블랙"), ("c", "utf-8", "레드")):
        (tmp_path / f"{name}.csv").write_bytes(f"color,n\n{word},1\n".encode(encoding))
    assert sorted(r["encoding"] for r in file_encodings(spark, str(tmp_path)).collect()) == ["cp949", "utf-8", "utf-8"]
    assert sorted(r["color"] for r in read_delimited(spark, str(tmp_path), None).collect()) == sorted(["화이트", "블랙", "레드"])


def test_every_written_file_starts_with_the_mark(spark, tmp_path):
    path = str(tmp_path / "out")
    write_delimited(spark.createDataFrame([(i, "가") for i in range(20)], "id int, v string").repartition(3), path, "utf-8-sig")
    parts = [p for p in (tmp_path / "out").iterdir() if p.suffix == ".csv"]
    assert len(parts) == 3 and all(p.read_bytes().startswith(b"\xef\xbb\xbfid,v") for p in parts)
    assert read_delimited(spark, path).filter("v = '가'").count() == 20


def test_headers(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int").toDF(BOM + "Perfume_ID ", " Spring")
    assert tidy_header(df).columns == ["Perfume_ID", "Spring"]
    assert tidy_header(df, lower=True).columns == ["perfume_id", "spring"]
    assert column_named(tidy_header(df), "year", "SPRING") == "Spring" and column_named(df, "x") is None


def document(number, style, **parts):
    def label(part):
        return [parts[part]] if part in parts else [{}]

    def rect(part):
        return [{"X좌표": -3.5, "Y좌표": 2, "가로": 20.2, "세로": 500}] if part in parts else []

    names = {"아우터": "outer", "하의": "bottom", "원피스": "dress", "상의": "top"}
    return {
        "이미지 정보": {"이미지 식별자": number, "이미지 높이": 100, "이미지 파일명": f"IMG_{number}.jpg", "이미지 너비": 80},
        "데이터셋 정보": {"데이터셋 상세설명": {
            "렉트좌표": {kr: rect(en) for kr, en in names.items()},
            "라벨링": {"스타일": [{"스타일": style, "서브스타일": "x"}], **{kr: label(en) for kr, en in names.items()}},
        }},
    }


def test_label_documents(spark, tmp_path):
    top = {"색상": "블랙", "서브색상": "레드", "소재": ["면", "울"], "옷깃": "셔츠칼라", "카테고리": "셔츠"}
    docs = {
        "로맨틱": [document(1, "로맨틱", top=top, bottom={"색상": "블루"}), document(2, "로맨틱", dress={"색상": "핑크"})],
        "섹시": [document(3, "섹시", top=top), document(4, "섹시", top=top, bottom={"색상": "블루"}, outer={"색상": "블루"})],
        "힙합": [document(5, "힙합", dress={"색상": "핑크"})],
    }
    for style, group in docs.items():
        (tmp_path / style).mkdir()
        for d in group:
            number = d["이미지 정보"]["이미지 식별자"]
            (tmp_path / style / f"{number}.json").write_text(json.dumps(d, ensure_ascii=False, indent=1), encoding="utf-8")
    rows = outfits.clean_labels(read_label_documents(spark, str(tmp_path), ["로맨틱", "섹시"]))
    assert not [c for c in rows.columns if c.endswith(("_collar", "_sub_color")) or c.startswith("label_")]
    got = {r["id"]: r for r in rows.collect()}
    assert set(got) == {1, 2}
    assert got[1]["top_material"] == "면, 울" and got[1]["style"] == "로맨틱" and got[1]["dress_color"] is None
    one, two = outfits.outfit_tables(rows)
    assert [r["id"] for r in one.collect()] == [2] and [r["id"] for r in two.collect()] == [1]
    assert "top_color" not in one.columns and "dress_color" not in two.columns
    assert [tuple(r) for r in outfits.crop_boxes(rows, "dress").collect()] == [(2, 0, 0, 2, 20, 100)]


@pytest.fixture
def action_files(spark):
    batches = [
        [(1, 10, "add", 5, 1), (1, 11, "add", 7, 2), (2, 10, "add", 9, 3)],
        [(1, 10, "add", 80, 4), (1, 11, "delete", None, 5)],
        [(1, 11, "add", 3, 6), (2, 10, "delete", None, 7), (3, 12, "add", 1, 8)],
    ]
    path = scratch_path(spark, "actions")
    schema = "session_id long, item_id long, action string, rate long, event_id long"
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(path)
    return path, spark.read.parquet(path)


def test_basket_over_several_batches_equals_the_batch_form(spark, action_files):
    path, table = action_files
    sink = scratch_path(spark, "basket")
    stream = ratings.file_stream(spark, path, table, files_per_batch=1)
    query = ratings.start_basket(stream, sink)
    query.awaitTermination()
    assert len([p for p in query.recentProgress if p["numInputRows"] > 0]) == 3
    got = sorted(tuple(r) for r in ratings.read_basket(spark, sink).collect())
    assert got == [(1, 10, 80), (1, 11, 3), (3, 12, 1)]
    assert got == sorted(tuple(r) for r in ratings.current_basket(ratings.latest_actions(table)).collect())


def test_log_ids_continue_over_batches(spark):
    path, sink = scratch_path(spark, "finished"), scratch_path(spark, "log")
    for batch in ([("a", 1, 5), ("a", 2, 6), ("b", 1, 7)], [("c", 3, 8)], [("d", 4, 9), ("e", 4, 9)]):
        rows = [(ord(b), i, r) for b, i, r in batch]
        spark.createDataFrame(rows, "basket_id long, item_id long, rate long").coalesce(1).write.mode("append").parquet(path)
    ratings.start_log(ratings.file_stream(spark, path, spark.read.parquet(path), 1), sink).awaitTermination()
    got = spark.read.parquet(sink)
    ids = {r["basket_id"]: r["smelling_user_id"] for r in got.select("basket_id", "smelling_user_id").distinct().collect()}
    assert len(ids) == 5 and sorted(ids.values()) == [1, 2, 3, 4, 5] and got.count() == 6


def test_a_second_start_goes_on(spark):
    source, log, basket = scratch_path(spark, "again"), scratch_path(spark, "log"), scratch_path(spark, "basket")

    def add(rows):
        schema = "basket_id long, session_id long, item_id long, action string, rate long, event_id long"
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)

    def start():
        stream = ratings.file_stream(spark, source, spark.read.parquet(source), 1)
        ratings.start_log(stream.select("basket_id", "item_id", "rate"), log).awaitTermination()
        ratings.start_basket(stream.drop("basket_id"), basket).awaitTermination()

    add([(7, 1, 10, "add", 5, 1), (8, 2, 11, "add", 6, 2)])
    start()
    add([(9, 1, 10, "delete", None, 3), (9, 3, 12, "add", 4, 4)])
    start()
    start()
    rows = sorted((r["basket_id"], r["item_id"], r["smelling_user_id"]) for r in spark.read.parquet(log).collect())
    assert rows == [(7, 10, 1), (8, 11, 2), (9, 10, 3), (9, 12, 3)]
    assert sorted(tuple(r) for r in ratings.read_basket(spark, basket).collect()) == [(2, 11, 6), (3, 12, 4)]


def test_a_sink_without_its_checkpoint_is_refused(spark):
    source, sink = scratch_path(spark, "in"), scratch_path(spark, "out")
    rows = spark.createDataFrame([(1, 2, 3)], "basket_id long, item_id long, rate long")
    rows.write.parquet(source)
    rows.write.parquet(f"{sink}/batch_id=0")
    with pytest.raises(ValueError, match="checkpoint"):
        ratings.start_log(ratings.file_stream(spark, source, rows), sink)


def test_refit_goes_on_with_the_next_version(spark):
    from stylematch.plans.evaluate import search_weights

    scores = spark.createDataFrame([(1, i, i / 5.0, 0.5, 0.1) for i in range(5)], "user_id long, item_id long, style_score double, color_score double, season_score double")
    path, out = scratch_path(spark, "ratings"), scratch_path(spark, "refit")
    for item in (4, 3):
        spark.createDataFrame([(1, item)], "user_id long, item_id long").write.mode("append").parquet(path)
        stream = ratings.file_stream(spark, path, spark.read.parquet(path))
        ratings.start_refit(stream, f"{out}/log", f"{out}/weights", lambda log: search_weights(scores, log, rated_only=True)).awaitTermination()
    assert sorted(r["weight_id"] for r in spark.read.parquet(f"{out}/weights").collect()) == [1, 2]
    assert spark.read.parquet(f"{out}/log").count() == 2


def test_refit_appends_a_version_per_batch(spark):
    from stylematch.plans.evaluate import search_weights

    scores = spark.createDataFrame(
        [(u, i, i / 20.0, (i * 7 % 20) / 20.0, (i * 3 % 20) / 20.0) for u in (1, 2) for i in range(20)],
        "user_id long, item_id long, style_score double, color_score double, season_score double",
    )
    path, out = scratch_path(spark, "ratings"), scratch_path(spark, "refit")
    for batch in ([(1, 19), (1, 18), (1, 17)], [(2, 13), (2, 6)]):
        spark.createDataFrame(batch, "user_id long, item_id long").coalesce(1).write.mode("append").parquet(path)
    stream = ratings.file_stream(spark, path, spark.read.parquet(path), 1)
    ratings.start_refit(stream, f"{out}/log", f"{out}/weights", lambda log: search_weights(scores, log, rated_only=True)).awaitTermination()
    versions = spark.read.parquet(f"{out}/weights").orderBy("weight_id").collect()
    assert [v["weight_id"] for v in versions] == [1, 2] and spark.read.parquet(f"{out}/log").count() == 5
    assert all(abs(v["w_style"] + v["w_color"] + v["w_season"] - 1) < 1e-9 for v in versions)
