"""The library's functions under their names in SQL."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import text as T
from .numeric import _py_round


def _raw(pattern: str) -> str:
    return "r'" + pattern.replace("'", "\\u0027") + "'"


def _blanked(x: str, *patterns: str) -> str:
    return f"regexp_replace({x}, {_raw('(?U)' + '|'.join(f'(?:{p})' for p in patterns))}, ' ')"


def _one_space(x: str) -> str:
    outer = r"(?U)^\s+|\s+$"
    return f"regexp_replace(regexp_replace({x}, {_raw(r'(?U)\s+')}, ' '), {_raw(outer)}, '')"


def _without_hollow(x: str) -> str:
    """As text.without_hollow: a fold over runs of characters."""
    opens, closes, filler = T._OPEN, T._CLOSE, rf"\s{T._MARKS}"
    run = _raw(rf"(?U)([{opens}]|[{closes}]|[{filler}]+|[^{opens}{closes}{filler}]+)")
    all_but_last = "slice(pieces, 1, size(pieces) - 1)"
    return f"""aggregate(regexp_extract_all({x}, {run}, 1), array(''), (pieces, run) -> CASE
        WHEN run RLIKE {_raw(f'^[{opens}]')} THEN concat(pieces, array(run))
        WHEN run RLIKE {_raw(f'^[{closes}]')} AND size(pieces) > 1 THEN concat(slice(pieces, 1, size(pieces) - 2), array(concat(pieces[size(pieces) - 2], ' ')))
        WHEN run RLIKE {_raw(rf'(?U)^[{filler}]')} THEN concat({all_but_last}, array(concat(element_at(pieces, -1), run)))
        ELSE array(concat(array_join(pieces, ''), run)) END, pieces -> array_join(pieces, ''))"""


def _tidy(x: str) -> str:
    x = _blanked(_without_hollow(x), rf"(?<!\S)[{T._MARKS}]+(?!\S)")
    x = f"regexp_replace(regexp_replace({x}, {_raw(r'(?U)\s*_[\s_]*')}, '_'), '[・、,/]{{2,}}', '・')"
    edges = rf"^[ {T._MARKS}]+|[ {T._MARKS}]+\z"
    return f"regexp_replace({_one_space(x)}, {_raw(edges)}, '')"


@F.arrow_udtf(returnType="stem bigint, sheet_no int, sheet_name string, area_no int, range string, check_no int, rule_id string, n_violations int")
class FlattenChecks:
    """flatten_checks(TABLE(documents)): a row for each check of nested documents (stem, sheets), with ordinals from 1.

    Documents stream through in Arrow batches, opened level by level as columns; null arrays have no rows. PARTITION BY does no
    harm, but calls this once for each partition.
    """

    def eval(self, documents: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sheets = documents.column("sheets")
        doc, sheet_no = self.elements(sheets)
        sheet = sheets.flatten()
        areas = pc.struct_field(sheet, "areas")
        of_sheet, area_no = self.elements(areas)
        area = areas.flatten()
        checks = pc.struct_field(area, "checks")
        of_area, check_no = self.elements(checks)
        check = checks.flatten()
        of_sheet, area_no = of_sheet[of_area], area_no[of_area]  # of each check from here
        n_violations = pc.fill_null(pc.list_value_length(pc.struct_field(check, "violations")), 0)
        columns = {
            "stem": documents.column("stem").take(pa.array(doc[of_sheet])), "sheet_no": sheet_no[of_sheet], "sheet_name": pc.struct_field(sheet, "name").take(pa.array(of_sheet)),
            "area_no": area_no, "range": pc.struct_field(area, "range").take(pa.array(of_area)), "check_no": check_no, "rule_id": pc.struct_field(check, "rule_id"), "n_violations": n_violations,
        }
        yield pa.RecordBatch.from_pydict(columns)

    @staticmethod
    def elements(arrays: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """The place of its array, and the ordinal in it, of each element."""
        lengths = pc.fill_null(pc.list_value_length(arrays), 0).to_numpy(zero_copy_only=False)
        place = np.repeat(np.arange(len(lengths)), lengths)
        return place, (np.arange(len(place)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + 1).astype(np.int32)


def register(spark: SparkSession) -> None:
    """nfkc, py_round, title_stem, title_stem_with_region, normal_name, and the table function flatten_checks, for spark.sql.

    Titles are SQL functions, which the optimizer opens up: only nfkc runs in Python, and py_round and flatten_checks where they are used.
    """
    spark.udf.register("nfkc", T.nfkc)
    spark.udf.register("py_round", _py_round)
    spark.udtf.register("flatten_checks", FlattenChecks)
    bodies = {
        "title_stem": _tidy(_blanked(_blanked("nfkc(title)", *T.PERIODS), *T.REGIONS)),
        "title_stem_with_region": _tidy(_blanked("nfkc(title)", *T.PERIODS)),
        "normal_name": _one_space("nfkc(title)"),
    }
    for name, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(title STRING) RETURNS STRING RETURN {body}")
