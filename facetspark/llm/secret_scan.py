"""Secret scan by a trigram inverted index, in DataFrame operations only.

A Boolean trigram query is derived from each rule's regex: every string that the
regex matches holds the trigrams of one of the query's clauses. The index maps each
trigram that some query asks for to the rows that hold it; a rule's postings are
intersected per clause, and only the rows that stay are verified with the regex. A
rule without mandatory trigrams scans every row.

Index and queries are over lower-cased text, so letter case never loses a row.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product
from re import _constants as sre
from re import _parser as sre_parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import stored


@dataclass(frozen=True)
class Rule:
    """A match counts if its ``group`` has ``least`` or more code points; shorter ones are dropped, not retried."""

    kind: str
    pattern: str
    least: int = 1
    group: int = 0


# The three base kinds, in order.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 16),
    Rule("hex", r"[0-9a-f]+", 32),
)
# Kinds that the method adds; base spans stay whatever these find.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("code_host_token", r"gh[oprsu]_[A-Za-z0-9]+", 40),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]+", 20),
    Rule("signed_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40),
    Rule("url_password", r"://[A-Za-z0-9_.-]+:[A-Za-z0-9_.%-]+@", 8),
)
RULES = BASE_RULES + MORE_RULES
MARK = "[SECRET]"
_STRINGS, _CLAUSES, _BLOCK = 64, 256, 64


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Clauses of lower-case trigrams: a match holds all trigrams of at least one. None: nothing is mandatory."""
    strings, clauses = _analyse(sre_parser.parse(pattern))
    return _either(_both(clauses, _needs(strings)))


def _needs(strings: set[str]) -> list[frozenset[str]]:
    """The clauses that a text holding one of these strings meets; an empty clause asks for nothing."""
    return [frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in strings]


def _both(a: list[frozenset[str]], b: list[frozenset[str]]) -> list[frozenset[str]]:
    """Clauses of both queries; if there are too many, those of one (still necessary)."""
    if len(a) * len(b) > _CLAUSES:
        return max(a, b, key=lambda q: min(map(len, q)))
    return list({x | y for x, y in product(a, b)})


def _either(clauses: list[frozenset[str]]) -> list[frozenset[str]] | None:
    least = [c for c in set(clauses) if not any(o < c for o in clauses)]
    return None if frozenset() in least or len(least) > _CLAUSES else sorted(least, key=sorted)


def _analyse(tree) -> tuple[set[str], list[frozenset[str]]]:
    """What the pattern's end must spell (a set of strings, {''} if open) and the clauses met before it."""
    tail, clauses = {""}, [frozenset()]
    for op, arg in tree:
        spelled, inner = _element(op, arg)
        if inner is not None:
            clauses = _both(clauses, inner)
        if spelled is not None and len(tail) * len(spelled) <= _STRINGS:
            tail = {a + b for a, b in product(tail, spelled)}
        else:
            clauses = _both(clauses, _needs(tail))
            tail = spelled or {""}
    return tail, clauses


def _element(op, arg) -> tuple[set[str] | None, list[frozenset[str]] | None]:
    """The strings an element spells (None: open) and the clauses it asks for besides (None: none)."""
    if op is sre.LITERAL:
        return {chr(arg).lower()}, None
    if op is sre.IN and all(o is sre.LITERAL for o, _ in arg):
        return {chr(c).lower() for _, c in arg}, None
    if op is sre.AT:
        return {""}, None
    if op is sre.SUBPATTERN:
        return _whole(arg[-1])
    if op is sre.BRANCH:
        parts = [_whole(x) for x in arg[1]]
        if all(s is not None for s, _ in parts):
            return set().union(*(s for s, _ in parts)), None
        return None, [c for s, q in parts for c in _both(_needs(s or {""}), q or [frozenset()])]
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        least, most, inner = arg
        spelled, asked = _whole(inner)
        if spelled is not None and most == 1:
            return spelled | ({""} if least == 0 else set()), None
        if least == 0:
            return None, None
        return None, _both(_needs(spelled or {""}), asked or [frozenset()])
    return None, None


def _whole(tree) -> tuple[set[str] | None, list[frozenset[str]] | None]:
    """An element's strings if the whole sequence is spelled out, else its clauses."""
    tail = {""}
    for op, arg in tree:
        spelled, inner = _element(op, arg)
        if spelled is None or inner is not None or len(tail) * len(spelled) > _STRINGS:
            strings, clauses = _analyse(tree)
            return None, _both(clauses, _needs(strings))
        tail = {a + b for a, b in product(tail, spelled)}
    return tail, None


def trigram_index(rows: DataFrame, trigrams: list[str], key_col: str, text_col: str) -> DataFrame:
    """Postings ``(trigram, key)`` of the given trigrams over lower-cased text; nulls hold none."""
    low = rows.select(F.col(key_col).alias("key"), F.lower(text_col).alias("low"))
    held = F.array_compact(F.array(*(F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams)))
    return low.select("key", F.explode(held).alias("trigram")).select("trigram", "key").distinct()


def candidates(index: DataFrame, queries: dict[str, list[frozenset[str]]], trigrams: list[str]) -> DataFrame:
    """``(key, kinds)``: the rules whose trigram query a row meets, by intersecting postings."""
    words = -(-len(trigrams) // 62)
    place = {t: divmod(i, 62) for i, t in enumerate(trigrams)}
    bits = F.create_map(*(x for t, (_, b) in place.items() for x in (F.lit(t), F.lit(1 << b).cast("long"))))
    word = F.create_map(*(x for t, (w, _) in place.items() for x in (F.lit(t), F.lit(w))))
    held = index.select("key", word[F.col("trigram")].alias("w"), bits[F.col("trigram")].alias("b")).groupBy("key").agg(
        *(F.coalesce(F.bit_or(F.when(F.col("w") == w, F.col("b"))), F.lit(0).cast("long")).alias(f"w{w}") for w in range(words)))

    def meets(clause: frozenset[str]) -> Column:
        mask = [sum(1 << place[t][1] for t in clause if place[t][0] == w) for w in range(words)]
        out = F.lit(True)
        for w, m in enumerate(mask):
            if m:
                out = out & (F.col(f"w{w}").bitwiseAND(F.lit(m).cast("long")) == F.lit(m).cast("long"))
        return out

    kinds = []
    for kind, clauses in queries.items():
        met = F.lit(False)
        for clause in clauses:
            met = met | meets(clause)
        kinds.append(F.when(met, F.lit(kind)))
    return held.select("key", F.array_compact(F.array(*kinds)).alias("kinds")).where(F.size("kinds") > 0)


def _add(part: Column) -> Column:
    return F.aggregate(part, F.lit(0), lambda a, x: a + x)


def _block_sums(lengths: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / _BLOCK).cast("int")),
                       lambda b: _add(F.slice(lengths, b * _BLOCK + 1, _BLOCK)))


def _sums_before(lengths: Column, blocks: Column) -> Column:
    """The sum of all entries before each entry, from whole blocks and the rest: far from n * n additions."""
    return F.transform(lengths, lambda _, i: _add(F.slice(blocks, 1, F.floor(i / _BLOCK).cast("int"))) + _add(
        F.slice(lengths, (F.floor(i / _BLOCK) * _BLOCK + 1).cast("int"), (i % _BLOCK).cast("int"))))


def scanned_pattern(rule: Rule) -> str:
    """The regex to look for: a bare run of one character class is asked for at its least length at once.

    Runs of a class are maximal, so those of ``least`` or more are the same matches.
    """
    tree = sre_parser.parse(rule.pattern)
    run = len(tree) == 1 and tree[0][0] is sre.MAX_REPEAT and tree[0][1][0] == 1 and tree[0][1][1] is sre.MAXREPEAT
    if run and rule.pattern.endswith("+") and not rule.group and [op for op, _ in tree[0][1][2]] == [sre.IN]:
        return f"{rule.pattern[:-1]}{{{rule.least},}}"
    return rule.pattern


def verified(df: DataFrame, rule: Rule, text_col: str, wanted: Column) -> DataFrame:
    """Adds column ``rule.kind``: array of (start, end) of the rule's matches in code points, end exclusive."""
    k, pattern = rule.kind, scanned_pattern(rule)
    none = F.array().cast("array<struct<start:int,end:int>>")
    df = df.withColumn(f"{k}_hit", F.when(wanted, F.regexp_extract_all(text_col, F.lit(pattern), F.lit(0))))
    df = df.withColumn(f"{k}_size", F.transform(f"{k}_hit", F.char_length))
    gap = F.when(F.size(f"{k}_hit") > 0, F.transform(F.split(text_col, pattern, -1), F.char_length))
    df = df.withColumn(f"{k}_gap", gap)
    step = F.transform(f"{k}_size", lambda n, i: n + F.element_at(f"{k}_gap", (i + 1).cast("int")))
    df = df.withColumn(f"{k}_step", step)
    # columns of their own: a lambda would compute them again for every element
    df = df.withColumn(f"{k}_blocks", F.when(F.size(f"{k}_step") > 0, _block_sums(F.col(f"{k}_step"))))
    df = df.withColumn(f"{k}_sum", F.when(F.size(f"{k}_step") > 0, _sums_before(F.col(f"{k}_step"), F.col(f"{k}_blocks"))))
    checked = F.transform(F.regexp_extract_all(text_col, F.lit(pattern), F.lit(rule.group)), F.char_length) if rule.group else F.col(f"{k}_size")
    df = df.withColumn(f"{k}_checked", F.when(F.size(f"{k}_hit") > 0, checked))
    spans = F.transform(f"{k}_size", lambda n, i: F.struct(
        (F.get(f"{k}_sum", i) + F.get(f"{k}_gap", i)).alias("start"),
        (F.get(f"{k}_sum", i) + F.get(f"{k}_gap", i) + n).alias("end"), F.get(f"{k}_checked", i).alias("checked")))
    spans = F.transform(F.filter(spans, lambda s: s["checked"] >= rule.least), lambda s: F.struct(s["start"], s["end"]))
    df = df.withColumn(k, F.coalesce(F.when(F.size(f"{k}_hit") > 0, spans), none))
    return df.drop(*(f"{k}_{x}" for x in ("hit", "size", "gap", "step", "blocks", "sum", "checked")))


def secret_scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text",
                carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: ``id``, ``text``, the columns in ``carry`` (as one struct, ``carried``) and ``spans``, an array of
    (start, rank, end, kind) ordered by start, then by rule.

    Matches are the leftmost non-overlapping ones of each rule; those shorter than
    the rule asks for are dropped. Null and empty texts have no spans. Rules overlap
    freely. Repeated rows give repeated rows, a null id stays null, other columns are
    not read.
    """
    kept = F.struct(*carry) if carry else F.lit(None).cast("int")
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), kept.alias("carried"))
    keyed = docs.withColumn("key", F.xxhash64("id", "text"))
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    indexed = {k: q for k, q in queries.items() if q}
    if indexed:
        trigrams = sorted(set().union(*(c for q in indexed.values() for c in q)))
        index = stored(trigram_index(keyed, trigrams, "key", "text"), "trigram-index")
        keyed = keyed.join(candidates(index, indexed, trigrams), "key", "left")
    else:
        keyed = keyed.withColumn("kinds", F.lit(None).cast("array<string>"))
    out = keyed
    for rule in rules:
        wanted = F.array_contains("kinds", rule.kind) if queries[rule.kind] else F.lit(True)
        out = verified(out, rule, "text", wanted)
    def labelled(n: int, kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(
            s["start"].alias("start"), F.lit(n).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind")))

    each = [labelled(n, r.kind) for n, r in enumerate(rules)]
    return out.select("id", "text", "carried", F.array_sort(F.concat(*each)).alias("spans"))


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def redacted(text: Column, spans: Column, mark: str = MARK) -> Column:
    """The text with every covered stretch replaced by ``mark``; overlapping spans give one mark."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(state: Column, s: Column) -> Column:
        fresh = s["start"] >= state["at"]
        out = F.when(fresh, F.concat(state["out"], F.substring(text, state["at"] + 1, s["start"] - state["at"]), F.lit(mark))).otherwise(state["out"])
        return F.struct(out.alias("out"), F.greatest(state["at"], s["end"]).alias("at"))

    done = F.aggregate(spans, start, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.char_length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def brute_force(text: str | None, rules: tuple[Rule, ...] = RULES) -> list[tuple[int, int, int, str]]:
    """(start, rank, end, kind) straight from the definition."""
    import re

    return sorted((m.start(), n, m.end(), r.kind) for n, r in enumerate(rules)
                  for m in re.finditer(r.pattern, text or "", re.ASCII) if len(m[r.group]) >= r.least)
