"""Titles, dates, numbers and names as catalogues write them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The period expressions, in the order in which they are tried.
_ERA = "(?:令和|平成|昭和|大正|明治)"
_MONTH = r"\d{1,2}月(?:期|分|号|末)?(?:現在|時点)?"
_DAY = r"\d{1,2}月\d{1,2}日(?:現在|時点)?"
PERIODS = [
    rf"\d{{4}}年{_DAY}",
    rf"\d{{4}}年{_MONTH}",
    r"\d{4}年度?",
    rf"{_ERA}(?:元|\d{{1,2}})年{_DAY}",
    rf"{_ERA}(?:元|\d{{1,2}})年{_MONTH}",
    rf"{_ERA}(?:元|\d{{1,2}})年度?",
    r"(?<![A-Za-z0-9])[HRSMT]\d{1,2}年度?",
    r"第\d{1,2}四半期",
    r"\d{1,2}[〜~‐–—-]\d{1,2}月期?",
    _DAY,
    _MONTH,
    "(?:上|下)半期",
    r"第\d{1,3}回",
    r"(?<!\d)(?:19|20)\d{2}(?:[〜~‐–—-](?:19|20)\d{2})?(?:年度?)?(?!\d)",
]
# The prefectures.
PREFECTURES = """
    北海道 青森県 岩手県 宮城県 秋田県 山形県 福島県 茨城県 栃木県 群馬県 埼玉県 千葉県 東京都 神奈川県 新潟県 富山県 石川県 福井県 山梨県 長野県 岐阜県 静岡県 愛知県 三重県
    滋賀県 京都府 大阪府 兵庫県 奈良県 和歌山県 鳥取県 島根県 岡山県 広島県 山口県 徳島県 香川県 愛媛県 高知県 福岡県 佐賀県 長崎県 熊本県 大分県 宮崎県 鹿児島県 沖縄県
""".split()
_FULL = "|".join(PREFECTURES)
_SHORT = "|".join(name[:-1] for name in PREFECTURES if name != "北海道")
# What may stand beside a prefecture's short name, the brackets, and the marks that may be left over.
_BESIDE = r"[_・()\[\]\s/、,‐–—-]"
_OPEN, _CLOSE = r"(\[【〈《「『", r")\]】〉》」』"
_MARKS = "・、,/〜~‐–—_-"
REGIONS = [rf"(?<![0-9])(?:[0-9]{{1,2}})?(?:{_FULL})", rf"(?<![0-9])[0-9]{{1,2}}(?:{_SHORT})(?![都府県])", rf"(?:^|(?<={_BESIDE}))(?:{_SHORT})(?={_BESIDE}|\z)"]


@F.pandas_udf(StringType())
def nfkc(texts):
    """The only Python here: Spark has no Unicode normalization."""
    return texts.fillna("").str.normalize("NFKC")


def _blanked(x: Column, *patterns: str) -> Column:
    return F.regexp_replace(x, "(?U)" + "|".join(f"(?:{p})" for p in patterns), " ")


def without_hollow(x: Column) -> Column:
    """Brackets that hold only marks, white space and other such brackets become a space.

    One fold over runs of characters: what is written so far is kept in pieces, of which each but the first starts with a bracket that may
    still turn out hollow. A closing bracket takes the last such piece back; anything solid joins all pieces, since none can be hollow then.
    """
    filler = rf"\s{_MARKS}"
    runs = F.regexp_extract_all(x, F.lit(rf"(?U)([{_OPEN}]|[{_CLOSE}]|[{filler}]+|[^{_OPEN}{_CLOSE}{filler}]+)"), F.lit(1))

    def grown(pieces: Column, run: Column) -> Column:
        on_last = lambda pieces, end: F.concat(F.slice(pieces, F.lit(1), F.size(pieces) - 1), F.array(F.concat(F.element_at(pieces, -1), end)))
        outer = F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(1)))
        return (
            F.when(run.rlike(f"^[{_OPEN}]"), F.concat(pieces, F.array(run)))
            .when(run.rlike(f"^[{_CLOSE}]") & (F.size(pieces) > 1), on_last(outer, F.lit(" ")))
            .when(run.rlike(rf"(?U)^[{filler}]"), on_last(pieces, run))
            .otherwise(F.array(F.concat(F.array_join(pieces, ""), run)))
        )

    return F.aggregate(runs, F.array(F.lit("")), grown, lambda pieces: F.array_join(pieces, ""))


def _tidy(x: Column) -> Column:
    """Without hollow brackets and marks that stand alone; runs of underscores, separators and white space become one."""
    alone = rf"(?<!\S)[{_MARKS}]+(?!\S)"
    x = _blanked(without_hollow(x), alone)
    x = F.regexp_replace(F.regexp_replace(x, r"(?U)\s*_[\s_]*", "_"), "[・、,/]{2,}", "・")
    return F.regexp_replace(_one_space(x), rf"^[ {_MARKS}]+|[ {_MARKS}]+\z", "")


def _one_space(x: Column) -> Column:
    return strip(F.regexp_replace(x, r"(?U)\s+", " "))


def title_stem(title: str | Column) -> Column:
    """A title without periods and prefectures: what stays the same from one issue and place to the next. Null as empty."""
    return _tidy(_blanked(_blanked(nfkc(title), *PERIODS), *REGIONS))


def title_stem_with_region(title: str | Column) -> Column:
    """As title_stem, but prefectures stay."""
    return _tidy(_blanked(nfkc(title), *PERIODS))


def normal_name(name: str | Column) -> Column:
    return _one_space(nfkc(name))


def strip(x: Column) -> Column:
    """Without outer white space, Unicode's included."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def is_blank(x: Column) -> Column:
    return x.isNull() | (strip(x) == "")


def is_numeric(x: Column) -> Column:
    """Whether a text is a number as tables print them: thousands commas, △ or ▲ for minus, a trailing percent sign."""
    bare = F.rtrim(F.translate(F.regexp_replace(strip(x), ",", ""), "△▲", "--"), F.lit("%"))
    return F.coalesce(bare.rlike(r"^[+-]?(?:\d+(?:_\d+)*\.?(?:\d+(?:_\d+)*)?|\.\d+(?:_\d+)*)(?:[eE][+-]?\d+)?$|^[+-]?(?i:nan|inf|infinity)$"), F.lit(False))


def date_key(x: Column) -> Column:
    """The latest YYYYMM of all runs of 4 to 6 digits (four digits are a year); -1 without any."""
    keys = F.transform(F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(r"(\d{4,6})"), F.lit(1)), lambda t: F.when(F.length(t) == 4, t.cast("int") * 100).otherwise(t.cast("int")))
    return F.coalesce(F.array_max(keys), F.lit(-1))


def date_value(x: Column) -> Column:
    """As date_key, but what counts as a year is a value below 10,000."""
    keys = F.transform(F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(r"(\d{4,6})"), F.lit(1)), lambda t: F.when(t.cast("int") < 10000, t.cast("int") * 100).otherwise(t.cast("int")))
    return F.coalesce(F.array_max(keys), F.lit(-1))


def first_number(x: Column, otherwise: int = 10**9) -> Column:
    return F.coalesce(F.regexp_extract(x, r"(\d+)", 1).try_cast("long"), F.lit(otherwise))


def rule_level(rule_id: Column) -> Column:
    """The number in the part before the hyphen; 0 if there is none."""
    return F.coalesce(F.regexp_replace(F.split_part(rule_id, F.lit("-"), F.lit(1)), "^[Ll]+|[Ll]+$", "").try_cast("int"), F.lit(0))


def resource_number(url: Column) -> Column:
    return F.regexp_extract(url, r"statInfId=(\d+)", 1)


def extension(name: Column) -> Column:
    return F.regexp_extract(F.lower(name), r"\.[^.]+$", 0)


def digest_id(*parts: Column) -> Column:
    """16 hex digits of SHA-1 over the parts, which a unit separator joins."""
    return F.substring(F.sha1(F.concat_ws("\x1f", *parts).cast("binary")), 1, 16)


def content_hash(content: Column) -> Column:
    return F.substring(F.sha2(content, 256), 1, 16)


def stable_seed(base: int, key: Column) -> Column:
    return F.lit(base) + F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long")


def file_kind(head: Column) -> Column:
    """xlsx, xls or bin by the first bytes."""
    return F.when(F.startswith(head, F.lit(b"PK")), "xlsx").when(F.startswith(head, F.lit(bytes.fromhex("D0CF11E0"))), "xls").otherwise("bin")


def entry_weight(x: Column) -> Column:
    value = x.try_cast("double")
    return F.when(value > 0, value).otherwise(1.0)
