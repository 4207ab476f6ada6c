"""Column functions that decode the fields of call rows, and say what is wrong with a field that cannot be decoded.

Numbers are taken strictly: no blanks around them, no type suffixes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from lociflow import schema

INT = r"[+-]?+[0-9]++"
UNSIGNED = r"[+]?+[0-9]++"
FLOAT = r"[+-]?+(?:[0-9]++(?:\.[0-9]*+)?+(?:[eE][+-]?+[0-9]++)?+|\.[0-9]++(?:[eE][+-]?+[0-9]++)?+|(?i:infinity|inf|nan))"
#: Strand-bias codes.
STRAND_BIAS = {"0": "TooFewReads", "1": "Detected", "2": "UnDetected"}
#: What a pair of biases and structural evidence are where nothing is known of them.
DEFAULT_PAIR = {"reference": "UnDetected", "alternate": "UnDetected"}
DEFAULT_SV = {"supporting_split_reads": 0, "supporting_pairs": 0, "supporting_clusters": 0}


def default_pair() -> Column:
    return F.struct(*[F.lit(v).alias(k) for k, v in DEFAULT_PAIR.items()])


def default_sv() -> Column:
    return F.struct(*[F.lit(v).alias(k) for k, v in DEFAULT_SV.items()])


def whole(pattern: str) -> str:
    return rf"^(?:{pattern})\z"


def integer(s: Column) -> Column:
    return F.when(s.rlike(whole(INT)), s.try_cast("int"))


def unsigned(s: Column) -> Column:
    return F.when(s.rlike(whole(UNSIGNED)), s.try_cast("bigint"))


def real(s: Column) -> Column:
    return F.when(s.rlike(whole(FLOAT)), s.try_cast("float"))


def _odds(x: Column) -> Column:
    one = F.lit(1.0).cast("float")
    return F.when(F.isnan(x), x).when(x == float("inf"), F.lit(0.0).cast("float")).when((x > 0) & (x < 1), (one / x).cast("float")).otherwise(x)


def odds_ratio(s: Column) -> Column:
    """A float whose positive infinity counts as 0 and whose values between 0 and 1 are inverted."""
    return _odds(real(s))


def duplication_rate(s: Column) -> Column:
    return F.when(s != "0", real(s))


def _sv(parts: list[Column]) -> Column:
    return F.struct(*parts).cast(schema.SV_INFO)


def sv_info(s: Column) -> Column:
    """Numbers of split reads, pairs and clusters from ``a-b-c``; further parts are ignored; ``0`` is null."""
    parts = [integer(F.get(F.split(s, "-", -1), F.lit(i))) for i in range(3)]
    there = parts[0].isNotNull() & parts[1].isNotNull() & parts[2].isNotNull()
    return F.when((s != "0") & there, _sv(parts))


def strand_bias(code: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, v in STRAND_BIAS.items():
        out = F.when(code == k, v).otherwise(out)
    return out


def pair_bias(s: Column) -> Column:
    """Strand bias of the reference and the alternate allele from ``a;b``."""
    pair = [strand_bias(F.substring(s, i, 1)) for i in (1, 3)]
    return F.when((F.length(s) == 3) & (F.substring(s, 2, 1) == ";") & pair[0].isNotNull() & pair[1].isNotNull(), F.struct(*pair).cast(schema.PAIR_BIAS))


def show_pair_bias(pair: Column) -> Column:
    return F.concat_ws(":", pair["reference"], pair["alternate"])


def show_sv_info(info: Column) -> Column:
    return F.concat_ws("-", info["supporting_split_reads"], info["supporting_pairs"], info["supporting_clusters"])


#: What decodes a field, null for one that cannot be decoded (and for the ``0`` of rates and structural evidence).
DECODERS = {"text": lambda s: s, "int": integer, "unsigned": unsigned, "float": real, "odds": odds_ratio, "pair": pair_bias, "rate": duplication_rate, "sv": sv_info, "optional": integer}
#: The same for the fields of rows without a problem, whose form is known: no field is checked once more.
FAST = DECODERS | {
    "int": lambda s: s.try_cast("int"),
    "unsigned": lambda s: s.try_cast("bigint"),
    "float": lambda s: s.try_cast("float"),
    "odds": lambda s: _odds(s.try_cast("float")),
    "rate": lambda s: F.when(s != "0", s.try_cast("float")),
    "sv": lambda s: F.when(s != "0", _sv([F.get(F.split(s, "-", -1), F.lit(i)).try_cast("int") for i in range(3)])),
    "optional": lambda s: s.try_cast("int"),
}
#: Forms that are decodable at sight, by kind: numbers of a few digits, so that none is out of range.
SMALL = r"[+-]?+[0-9]{1,9}+"
FORMS = {"text": r"[^\t]*+", "int": SMALL, "unsigned": r"[+]?+[0-9]{1,18}+", "float": FLOAT, "odds": FLOAT, "pair": "[012];[012]", "rate": FLOAT, "sv": rf"(?:[0-9]{{1,9}}+(?:-[0-9]{{1,9}}+){{2}}+(?:-[^\t]*+)?+|0)", "optional": SMALL}


def _plain() -> str:
    """Matches the tab-joined cells of a row whose fields all have such a form."""
    form = [FORMS[kind] for _, kind in schema.FIELDS]
    rest = r"(?:\t[\s\S]*+)?+"
    for f in reversed(form[schema.REQUIRED :]):
        rest = rf"(?:\t{f}{rest})?+"
    return "^" + r"\t".join(form[: schema.REQUIRED]) + rest + r"\z"


PLAIN = _plain()


def decoded(cells: Column, only: Sequence[str] | None = None) -> list[Column]:
    """Fields, all or those named, typed, from an array of texts; of no use where the row has a ``problem``."""
    return [FAST[kind](F.get(cells, F.lit(i))).alias(name) for i, (name, kind) in enumerate(schema.FIELDS) if only is None or name in only]


#: Every field as a row sees it: its place, name and kind.
LOOKED = ", ".join(f"named_struct('place', {i}, 'name', '{name}', 'kind', '{kind}')" for i, (name, kind) in enumerate(schema.FIELDS))


def problem(cells: Column) -> Column:
    """What makes a row undecodable, null for nothing: the first bad field in order of position.

    One pattern over the whole row passes nearly all rows. Only where it fails are fields looked at one by one, each by its
    kind: numbers of many digits, tabs within quotes, and rows that do have a problem.
    """

    def bad(x: Column) -> Column:
        cell, kind = x["cell"], x["field"]["kind"]
        out = cell.isNull()
        for k, decode in DECODERS.items():
            if k != "text":
                out = F.when(kind == k, decode(cell).isNull()).otherwise(out)
        zero = kind.isin("rate", "sv") & (F.coalesce(cell, F.lit("")) == "0")
        return out & ~zero & (cell.isNotNull() | (x["field"]["place"] < schema.REQUIRED))

    fields = F.zip_with(F.expr(f"array({LOOKED})"), F.slice(cells, 1, len(schema.FIELDS)), lambda f, c: F.struct(f.alias("field"), c.alias("cell")))
    first = F.get(F.filter(fields, bad), F.lit(0))
    told = F.concat(F.lit("could not decode field "), first["field"]["place"].cast("string"), F.lit(" ("), first["field"]["name"], F.lit("): "), F.coalesce(first["cell"], F.lit("missing")))
    return F.when(~F.array_join(cells, "\t").rlike(PLAIN), told)
