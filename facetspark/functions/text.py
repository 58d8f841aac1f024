"""Column -> Column text helpers. All JVM-side built-ins, no Python UDFs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's for identical output text.
MISSING_LABEL = "na"          # label sentinel for "no value"
NULL_TEXT = "None"            # how a missing value prints inside rendered text
CLASSIFIER_PARTS = ("Product Name: ", ", Sold by retailer: ", ", Price: ")

# Java regex: (?U) makes \s Unicode-aware like Python's str.strip().
_EDGE_WS = r"(?U)^\s+|\s+$"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c: Column | str) -> Column:
    """Trim leading/trailing whitespace of any kind (SQL ``trim`` only drops spaces)."""
    return F.regexp_replace(_c(c), _EDGE_WS, "")


def strip_line(c: Column | str) -> Column:
    """Whitespace strip, then strip ``{``/``}`` characters from both ends."""
    return F.regexp_replace(strip_ws(c), r"^[{}]+|[{}]+$", "")


def _let(value: Column, fn) -> Column:
    """Evaluate ``value`` once and bind it for ``fn`` (keeps expression trees small)."""
    return F.transform(F.array(value), fn)[0]


_SCI = r"^(-?)(\d)(?:\.(\d+))?[eE]([-+]?\d+)$"


def _python_float_text(d: Column) -> Column:
    """Python's repr of a double whose Java form uses an exponent."""
    # Python prints the shortest digit string that reads back to the same double.
    # JDK 17's Double.toString is not always shortest (``4.9E-324`` for 5e-324),
    # but it is at most a digit or two longer: try the two shorter lengths and
    # keep the first that round-trips, else Java's own digits.
    java = d.cast("string")
    digits = F.regexp_replace(F.regexp_replace(F.regexp_extract(java, r"^-?([0-9.]+)", 1), r"\.", ""), "0+$", "")
    n = F.length(F.regexp_replace(digits, "^0+", ""))
    lengths = F.when(n > 1, F.sequence(F.greatest(F.lit(1), n - 2), n - 1)).otherwise(F.array().cast("array<int>"))
    fmts = F.transform(lengths, lambda p: F.call_function(
        "format_string", F.concat(F.lit("%."), (p - 1).cast("string"), F.lit("e")), d))
    shortest = F.filter(fmts, lambda c: c.try_cast("double") == d)
    pick_b = F.coalesce(F.try_element_at(shortest, F.lit(1)), java)

    def parts(b: Column) -> Column:
        raw = F.regexp_replace(F.concat(F.regexp_extract(b, _SCI, 2), F.regexp_extract(b, _SCI, 3)), "0+$", "")
        return F.struct(F.regexp_extract(b, _SCI, 1).alias("sign"),
                        F.when(raw == "", F.lit("0")).otherwise(raw).alias("dg"),
                        F.regexp_extract(b, _SCI, 4).try_cast("int").alias("e"))

    def build(p: Column) -> Column:
        sign, dg, e = p["sign"], p["dg"], p["e"]
        n = F.length(dg)
        # exponent >= 0: integer part is the first e+1 digits (zero padded), rest is the fraction
        int_part = F.when(n <= e + 1, F.rpad(dg, e + 1, "0")).otherwise(F.substring(dg, F.lit(1), e + 1))
        frac = F.when(n > e + 1, F.substr(dg, e + 2)).otherwise(F.lit("0"))
        plain_pos = F.concat(sign, int_part, F.lit("."), frac)
        plain_neg = F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -e - 1), dg)
        mant = F.concat(F.substring(dg, 1, 1),
                        F.when(n > 1, F.concat(F.lit("."), F.substr(dg, F.lit(2)))).otherwise(F.lit("")))
        sci_txt = F.concat(sign, mant, F.lit("e"), F.when(e < 0, F.lit("-")).otherwise(F.lit("+")),
                           F.when(F.abs(e) < 10, F.lit("0")).otherwise(F.lit("")), F.abs(e).cast("string"))
        return (F.when((e >= 0) & (e < 16), plain_pos)
                .when((e < 0) & (e >= -4), plain_neg)
                .otherwise(sci_txt))

    return _let(pick_b, lambda b: _let(parts(b), build))


def num_text(c: Column | str) -> Column:
    """Render a number the way Python's ``str(float(x))`` does.

    Spark's double->string cast uses Java notation (``1.2345678E7``,
    ``9.0E-5``). Inside [1e-3, 1e7) the two agree and the cast is used as is;
    outside it Python's form is rebuilt from the digits and exponent: plain
    decimals for exponents -4..15, otherwise ``d.ddde+XX``.
    """
    d = _c(c).try_cast("double")
    s = d.cast("string")
    return (F.when(d.isNull(), F.lit(None).cast("string"))
            .when(F.isnan(d), F.lit("nan"))
            .when(d == float("inf"), F.lit("inf"))
            .when(d == float("-inf"), F.lit("-inf"))
            .when(~s.contains("E"), s)
            .otherwise(_python_float_text(d)))


def value_text(c: Column | str, null_text: str | None = NULL_TEXT) -> Column:
    """A value as it prints inside generated text; NULL prints as ``null_text``."""
    col = _c(c)
    return F.coalesce(col.cast("string"), F.lit(null_text)) if null_text is not None else col.cast("string")


def render_fields(fields: Sequence[tuple[str, Column]], null_text: str | None = NULL_TEXT,
                  sep: str = " ") -> Column:
    """``name: value`` pairs joined by ``sep`` in the given order (seq2seq inputs/targets)."""
    # With null_text=None a missing value makes its pair NULL and concat_ws skips it.
    parts = [F.concat(F.lit(f"{name}: "), value_text(col, null_text)) for name, col in fields]
    return F.concat_ws(sep, *parts)


def classifier_text(description: Column | str, retailer: Column | str, price: Column | str,
                    null_text: str | None = NULL_TEXT) -> Column:
    """``Product Name: d, Sold by retailer: r, Price: p``.

    ``null_text='None'`` keeps the reference's behaviour (its not-None guards
    never fire, so a missing value prints as ``None``). ``null_text=None``
    drops the clause of a missing value instead.
    """
    price_txt = num_text(_c(price))
    vals = [_c(description).cast("string"), _c(retailer).cast("string"), price_txt]
    a, b, c = CLASSIFIER_PARTS
    if null_text is None:
        return F.concat_ws("", F.concat(F.lit(a), vals[0]),
                           F.concat(F.lit(b), vals[1]), F.concat(F.lit(c), vals[2]))
    v = [F.coalesce(x, F.lit(null_text)) for x in vals]
    return F.concat(F.lit(a), v[0], F.lit(b), v[1], F.lit(c), v[2])


def to_json_text(*cols: Column | str) -> Column:
    """Record -> JSON text keeping NULL fields as ``null`` (``json.dumps`` style keys)."""
    return F.to_json(F.struct(*[_c(c) for c in cols]), {"ignoreNullFields": "false"})


def extraction_pattern(attrs: Sequence[str]) -> str:
    """Anchored pattern ``a1: (.*?) a2: (.*?) ... an: (.*)`` built from one attribute list.

    ``(?d)`` (UNIX_LINES) makes ``.`` stop only at ``\\n``, as Python's does.
    """
    import re
    body = " ".join(f"{re.escape(a)}: (.*?)" for a in attrs[:-1])
    last = f"{re.escape(attrs[-1])}: (.*)"
    return "(?d)^" + (body + " " if body else "") + last


def extract_fields(text: Column | str, attrs: Sequence[str], missing: str = MISSING_LABEL) -> list[Column]:
    """One column per attribute; all ``missing`` when the text doesn't match at its start."""
    t = _c(text)
    pat = extraction_pattern(attrs)
    hit = t.rlike(pat)
    return [F.when(hit, F.regexp_extract(t, pat, i + 1)).otherwise(F.lit(missing)).alias(a)
            for i, a in enumerate(attrs)]


def cut_marker(text: Column | str, marker: str) -> Column:
    """Text before the first occurrence of ``marker`` (whole text if absent)."""
    return F.substring_index(_c(text), marker, 1)


def last_word(text: Column | str) -> Column:
    return F.regexp_extract(_c(text), r"([^ ]+)$", 1)
