"""Print the table of inventory ids and the queries that cover them, for the README."""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from stylematch import workload  # noqa: E402


def main() -> None:
    checked = workload.oracles()
    by_id: dict[str, list[str]] = {}
    for name, ids in workload.COVERS.items():
        for i in ids:
            by_id.setdefault(i, []).append(f"`{name}`" + ("" if name in checked else " (rows only)"))
    print("| Id | Queries |\n|---|---|")
    for i in sorted(by_id, key=lambda x: ("SPJAWOUFMRET".index(x[0]), int(x[1:]))):
        print(f"| {i} | {', '.join(by_id[i])} |")


if __name__ == "__main__":
    main()
