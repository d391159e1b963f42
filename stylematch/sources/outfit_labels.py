"""Outfit label documents: one nested JSON document per photo, one folder per style."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stylematch.functions.text import first_element, join_list

# Field names of the label documents.
FIELD = {
    "length": "기장", "color": "색상", "sub_color": "서브색상", "category": "카테고리", "detail": "디테일",
    "sleeve_length": "소매기장", "material": "소재", "print": "프린트", "neckline": "넥라인", "collar": "옷깃",
    "fit": "핏",
}
LIST_FIELDS = ("detail", "material", "print")
RECT = {"x": "X좌표", "y": "Y좌표", "w": "가로", "h": "세로"}
PARTS = {"outer": "아우터", "bottom": "하의", "dress": "원피스", "top": "상의"}


def _part_type() -> str:
    fields = [f"`{kr}`: {'array<string>' if en in LIST_FIELDS else 'string'}" for en, kr in FIELD.items()]
    return f"array<struct<{', '.join(fields)}>>"


def label_schema() -> str:
    rects = ", ".join(
        f"`{kr}`: array<struct<{', '.join(f'`{r}`: double' for r in RECT.values())}>>" for kr in PARTS.values()
    )
    labels = ", ".join(f"`{kr}`: {_part_type()}" for kr in PARTS.values())
    return (
        "`이미지 정보` struct<`이미지 식별자`: bigint, `이미지 높이`: int, `이미지 파일명`: string, `이미지 너비`: int>, "
        "`데이터셋 정보` struct<`데이터셋 상세설명`: struct<"
        f"`렉트좌표`: struct<{rects}>, "
        f"`라벨링`: struct<`스타일`: array<struct<`스타일`: string, `서브스타일`: string>>, {labels}>>>"
    )


def read_label_documents(spark: SparkSession, path: str, styles: Sequence[str], multiline: bool = True) -> DataFrame:
    """Documents below the folders of the given styles, with an explicit schema."""
    docs = (
        spark.read.schema(label_schema()).option("multiLine", multiline)
        .option("recursiveFileLookup", True).json(path)
        .withColumn("source_path", F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))))
    )
    wanted = F.lit(False)
    for style in styles:
        wanted = wanted | F.col("source_path").contains(f"{style}/")
    return docs.filter(wanted)


def flatten_labels(docs: DataFrame) -> DataFrame:
    """Nested document to one wide row of named columns; the arrays stay arrays."""
    image, detail = "`이미지 정보`", "`데이터셋 정보`.`데이터셋 상세설명`"
    cols: list[Column] = [
        F.col(f"{image}.`이미지 식별자`").alias("id"),
        F.col(f"{image}.`이미지 높이`").alias("height"),
        F.col(f"{image}.`이미지 파일명`").alias("file_name"),
        F.col(f"{image}.`이미지 너비`").alias("width"),
    ]
    for part in ("bottom", "dress", "top"):
        cols.append(F.col(f"{detail}.`렉트좌표`.`{PARTS[part]}`").alias(f"rect_{part}"))
    cols.append(F.col(f"{detail}.`라벨링`.`스타일`").alias("label_style"))
    for part, kr in PARTS.items():
        cols.append(F.col(f"{detail}.`라벨링`.`{kr}`").alias(f"label_{part}"))
    return docs.select(*cols)


def expand_labels(wide: DataFrame) -> DataFrame:
    """Label arrays to columns: element 0 of each, list fields joined by ``", "``; the arrays are dropped."""
    style = first_element(F.col("label_style"))
    cols = {"style": style["스타일"], "sub_style": style["서브스타일"]}
    for part in ("bottom", "dress", "top"):
        first = first_element(F.col(f"label_{part}"))
        for en, kr in FIELD.items():
            value = first[kr]
            cols[f"{part}_{en}"] = join_list(value) if en in LIST_FIELDS else value
    gone = [c for c in wide.columns if c.startswith("label_")]
    return wide.withColumns(cols).drop(*gone)
