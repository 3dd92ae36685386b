"""Secret scans through a trigram inverted index, in DataFrame functions only.

From each rule's regular expression a Boolean query over trigrams is derived that every text with a match must satisfy:
clauses of trigrams, of which one clause must hold whole. Trigrams are of the lower-cased text, so that one index serves
rules of either case; for rules with cases that only adds candidates. A text that has the rarest trigram of no clause can
satisfy none; it isn't indexed. The index holds, for each trigram and each block of documents, the list of the others that
have it. The queries are answered by intersecting and uniting those lists; the answers are the candidates that the regular
expression then verifies. A rule whose expression has no mandatory trigram is verified on every text. Only indexed texts
meet the answers by a shuffle; all others are verified where they are read.

The expressions are read by the small parser below while the plan is made; nothing of Python runs on the executors.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, stash, without

BLOCK_DOCS = 4096  # documents in a block of the index
MOST_STRINGS = 64  # alternatives that the analysis follows before it settles for their trigrams


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str  # means the same to Java, Python's re and RE2
    group: int = 0  # the group whose length counts
    least: int = 0  # matches with fewer code points there are dropped, after matching
    base: bool = False


# The base rules of the contract. [0-9a-f]{24,} finds the runs of [0-9a-f]+ with at least 24 characters,
# and AKIA[A-Z0-9]{16,} those matches of AKIA[A-Z0-9]+ with at least 20: a shorter match ends with its run, and what
# begins later in the run is shorter still.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]{16,}", base=True),
    Rule("hex", r"[0-9a-f]{24,}", base=True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}[.]eyJ[A-Za-z0-9_-]{10,}[.][A-Za-z0-9_-]{10,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
)

#: A Boolean query is a set of clauses, each a set of trigrams: one clause must hold whole. {frozenset()} always holds.
Clauses = frozenset[frozenset[str]]
ALWAYS: Clauses = frozenset([frozenset()])


def _absorb(clauses) -> Clauses:
    clauses = set(clauses)
    return frozenset(c for c in clauses if not any(d < c for d in clauses))


def _both(a: Clauses, b: Clauses) -> Clauses:
    return _absorb(x | y for x in a for y in b) if len(a) * len(b) <= 4 * MOST_STRINGS else min(a, b, key=len)


def _of(strings: set[str]) -> Clauses:
    return _absorb(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings)


@dataclass(frozen=True)
class Part:
    """A part of an expression: a choice of sequences, or one of characters (None: too many to follow), so often."""

    options: tuple[tuple[Part, ...], ...] = ()
    chars: frozenset[str] | None = None
    least: int = 1
    most: int = 1 << 30


def parse(pattern: str) -> tuple[tuple[Part, ...], ...]:
    """The sequences that a pattern chooses from. It knows what the rules use: characters, escapes, sets, groups, |, ? * + {a,b}."""
    options, at = _choice(pattern, 0)
    if at < len(pattern):
        raise ValueError(f"unbalanced at {at}: {pattern}")
    return options


def _choice(p: str, at: int) -> tuple[tuple[tuple[Part, ...], ...], int]:
    options: list[list[Part]] = [[]]
    while at < len(p) and p[at] != ")":
        if p[at] == "|":
            options.append([])
            at += 1
            continue
        if p[at] == "(":
            for opening in ("(?i:", "(?:", "("):
                if p.startswith(opening, at):
                    inner, at = _choice(p, at + len(opening))
                    break
            if p[at : at + 1] != ")":
                raise ValueError(f"a group isn't closed: {p}")
            part, at = Part(inner), at + 1
        elif p[at] == "[":
            chars, at = _set(p, at + 1)
            part = Part(chars=chars)
        else:
            chars, at = _character(p, at)
            part = Part(chars=chars)
        least, most, at = _times(p, at)
        options[-1].append(Part(part.options, part.chars, least, most))
    return tuple(map(tuple, options)), at


def _character(p: str, at: int) -> tuple[frozenset[str] | None, int]:
    if p[at] == "\\":
        if p[at + 1] == "x":
            return frozenset(chr(int(p[at + 2 : at + 4], 16))), at + 4
        return (None if p[at + 1].isalnum() else frozenset(p[at + 1])), at + 2  # classes such as \d aren't followed
    if p[at] in ".^$":
        raise ValueError(f"{p[at]} isn't read: {p}")
    return frozenset(p[at]), at + 1


def _set(p: str, at: int) -> tuple[frozenset[str] | None, int]:
    """A set's characters; None where it has a range, is turned round or holds a class."""
    out: set[str] | None = None if p[at] == "^" else set()
    begin = at
    while p[at] != "]" or at == begin:
        chars, after = _character(p, at) if p[at] not in ".^$" else (frozenset(p[at]), at + 1)
        if p[after] == "-" and p[after + 1] != "]":
            chars, after = None, after + 2
        out = None if out is None or chars is None else out | chars
        at = after
    return (None if out is None else frozenset(out)), at + 1


def _times(p: str, at: int) -> tuple[int, int, int]:
    mark = p[at : at + 1]
    if mark == "{":
        end = p.index("}", at)
        low, comma, high = p[at + 1 : end].partition(",")
        return int(low), int(high) if high else (1 << 30 if comma else int(low)), end + 1
    return {"?": (0, 1, at + 1), "*": (0, 1 << 30, at + 1), "+": (1, 1 << 30, at + 1)}.get(mark, (1, 1, at))


def _exact(parts: tuple[Part, ...] | list[Part]) -> set[str] | None:
    """The lower-cased strings that a sequence can match, if they are few and of ASCII."""
    out = {""}
    for part in parts:
        if part.options:
            each = [_exact(o) for o in part.options]
            own = None if None in each else set().union(*each)
        else:
            own = {c.lower() for c in part.chars} if part.chars is not None and all(c.isascii() for c in part.chars) else None
        if own is not None and (part.least, part.most) != (1, 1):
            own = {"".join(x) for n in range(part.least, part.most + 1) for x in product(own, repeat=n)} if part.most <= 4 and len(own) ** part.most <= MOST_STRINGS else None
        if own is None or len(own) * len(out) > MOST_STRINGS:
            return None
        out = {a + b for a in out for b in own}
    return out


def _analyse(parts: tuple[Part, ...]) -> Clauses:
    query, run = ALWAYS, []

    def settle() -> None:
        nonlocal query, run
        if run:
            query, run = _both(query, _of(_exact(run))), []

    for part in parts:
        if _exact([*run, part]) is None:
            settle()
        if _exact([*run, part]) is not None:
            run.append(part)
        elif part.options and part.least >= 1:
            query = _both(query, _absorb(c for o in part.options for c in _analyse(o)))
    settle()
    return query


def trigram_query(pattern: str) -> Clauses:
    """The trigrams that any text matched by the pattern must have, as clauses; ALWAYS if there are none."""
    return _absorb(c for o in parse(pattern) for c in _analyse(o))


# Letters from the most to the least frequent in texts; other characters are rarer than all of them.
FREQUENT = "etaoinshrdlucmwfgypbvkjxqz"


def rarest(clause: frozenset[str]) -> str:
    """The trigram of a clause that the fewest texts should have, by its letters."""
    return max(sorted(clause), key=lambda t: sum(FREQUENT.index(c) if c in FREQUENT else 15 for c in set(t)))


def gate(low: Column, clauses: Clauses) -> Column:
    """Whether a lower-cased text has the rarest trigram of some clause."""
    names = sorted({rarest(c) for c in clauses})
    return F.rlike(low, F.lit("|".join("".join("\\" + c if not c.isalnum() else c for c in t) for t in names)))


def build_index(docs: DataFrame, clauses: Clauses, id_col: str = "doc_id", text_col: str = "text", blocks: int = 1) -> DataFrame:
    """(block, trigram, ids): posting lists of the clauses' trigrams, each of one block's documents; null ids have none.

    A text is looked through for a clause's other trigrams only if it has the rarest one.
    """
    low = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.lower(F.col(text_col)).alias("low"))
    none = F.array().cast("array<string>")

    def has(t: str) -> Column:
        return F.contains("low", F.lit(t))

    def found(clause: frozenset[str]) -> Column:
        first = rarest(clause)
        return F.when(has(first), F.array(F.lit(first), *(F.when(has(t), F.lit(t)) for t in sorted(clause - {first})))).otherwise(none)

    rows = low.select("id", F.explode(F.array_distinct(F.flatten(F.array(*map(found, sorted(clauses, key=sorted)))))).alias("trigram")).where("trigram is not null")
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block")
    return rows.select(block, "trigram", "id").groupBy("block", "trigram").agg(F.collect_set("id").alias("ids"))


def answer(index: DataFrame, queries: dict[str, Clauses]) -> DataFrame:
    """(id, kinds): the documents that satisfy each kind's clauses, by intersecting the posting lists of each block."""
    needed = sorted({t for q in queries.values() for c in q for t in c})
    name = {t: f"p{i}" for i, t in enumerate(needed)}
    none = F.lit(None).cast(index.schema["ids"].dataType)
    lists = index.groupBy("block").agg(*(F.coalesce(F.first(F.when(F.col("trigram") == t, F.col("ids")), True), F.array().cast(index.schema["ids"].dataType)).alias(name[t]) for t in needed)) if needed else index.select("block", none.alias("p")).limit(0)

    def meet(clause: frozenset[str]) -> Column:
        first, *rest = (F.col(name[t]) for t in sorted(clause))
        for x in rest:
            first = F.array_intersect(first, x)
        return first

    def hits(kind: str, q: Clauses) -> Column:
        return F.transform(F.array_distinct(F.flatten(F.array(*map(meet, sorted(q, key=sorted))))), lambda x: F.struct(x.alias("id"), F.lit(kind).alias("kind")))

    found = lists.select(F.inline(F.flatten(F.array(*(hits(kind, q) for kind, q in queries.items())))))
    return found.groupBy("id").agg(F.collect_set("kind").alias("kinds"))


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """array<struct<start, ord, end, kind>> of a rule's matches: the text is split at them and lengths are summed."""
    pattern = F.lit(rule.pattern)
    pieces, hits = F.split(text, rule.pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0))
    kept = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.least else hits
    rows = F.arrays_zip(pieces.alias("gap"), hits.alias("hit"), kept.alias("kept"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        new = F.struct(start.alias("start"), F.lit(order).alias("ord"), end.alias("end"), F.lit(rule.kind).alias("kind"))
        take = x["hit"].isNotNull() & (F.length(x["kept"]) >= rule.least)
        return F.struct(F.coalesce(end, start).alias("at"), F.when(take, F.concat(acc["out"], F.array(new))).otherwise(acc["out"]).alias("out"))

    empty = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out"))
    return F.aggregate(rows, empty, step, lambda acc: acc["out"])


SPANS = "array<struct<start:int,ord:int,end:int,kind:string>>"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with a column spans: array<struct<start, ord, end, kind>> by start, then the rules' order.

    start and end count code points, end exclusive. Matches of one kind don't overlap; kinds may. A null text counts as
    empty. Repeated rows and ids each keep their row (candidates of one id are verified on each of its texts); rows with a
    null id are verified by every rule. Whole texts are verified. An empty table gives an empty result. Further columns
    stay, whatever their names; a column named spans is replaced.
    """
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    indexed = {k: q for k, q in queries.items() if q != ALWAYS}
    docs = docs.select(*without(docs.columns, "spans"))
    text = F.coalesce(F.col(text_col), F.lit(""))

    def verified(rows: DataFrame, may) -> DataFrame:
        parts = []
        for order, rule in enumerate(rules):
            wanted = may(rule.kind)
            if wanted is not None:
                parts.append(F.when(wanted & F.rlike(text, F.lit(rule.pattern)), _spans(text, rule, order)).otherwise(F.array().cast(SPANS)))
        return rows.withColumn("spans", F.array_sort(F.flatten(F.array(*parts))) if parts else F.array().cast(SPANS))

    always = verified(docs, lambda kind: None if kind in indexed else F.lit(True))
    if not indexed:
        return always
    clauses = frozenset(c for q in indexed.values() for c in q)
    passed = gate(F.lower(text), clauses)
    held = stash(docs.where(passed), "indexed")
    blocks = max(1, -(-held.count() // BLOCK_DOCS))
    cand, kinds = fresh(docs.columns, "cand", "kinds")
    wanted = answer(build_index(held, clauses, id_col, text_col, blocks), indexed).select(F.col("id").alias(cand), F.col("kinds").alias(kinds))
    met = held.join(wanted, F.col(id_col) == F.col(cand), "left")

    def may(kind: str) -> Column:
        return F.col(id_col).isNull() | F.coalesce(F.array_contains(kinds, kind), F.lit(False)) if kind in indexed else F.lit(True)

    return verified(met, may).drop(cand, kinds).unionByName(always.where(~passed))


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat(s["kind"], F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def digest(scanned: DataFrame, id_col: str = "doc_id", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts of the base kinds, the hash of their spans, and all spans as text."""
    base = F.filter("spans", lambda s: s["ord"].isin([i for i, r in enumerate(rules) if r.base]))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(r.kind) for r in rules if r.base]
    return scanned.select(F.col(id_col), *counts, F.sha2(spans_text(base).cast("binary"), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"))


def redact(scanned: DataFrame, text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """The scanned rows, with every stretch of text under at least one span replaced by the mask; spans is dropped."""
    text = F.col(text_col)

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], F.array(gap, F.lit(mask)))).otherwise(acc["out"]).alias("out"))

    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    clean = F.aggregate("spans", empty, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    return scanned.withColumn(text_col, F.when(F.size("spans") > 0, clean).otherwise(text)).drop("spans")


def oracle(rules: tuple[Rule, ...] = RULES) -> str:
    """The digest in DuckDB's SQL, from every rule's expression on every text."""
    parts = []
    for order, r in enumerate(rules):
        p = r.pattern.replace("'", "''")
        parts.append(
            f"SELECT doc_id, rid, {order} AS ord, '{r.kind}' AS kind, unnest(range(1, len(hits) + 1)) AS i, gaps, hits, kept FROM "
            f"(SELECT doc_id, rid, string_split_regex(text, '{p}') AS gaps, regexp_extract_all(text, '{p}', 0) AS hits, regexp_extract_all(text, '{p}', {r.group}) AS kept FROM t)"
        )
    least = " ".join(f"WHEN {o} THEN {r.least}" for o, r in enumerate(rules))
    bases = ", ".join(str(o) for o, r in enumerate(rules) if r.base)
    counts = ", ".join(f"CAST(count(*) FILTER (kind = '{r.kind}') AS BIGINT) AS n_{r.kind}" for r in rules if r.base)
    return f"""
WITH t AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS text FROM documents),
m AS ({" UNION ALL ".join(parts)}),
s AS (SELECT rid, ord, kind, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i-1], lambda x: length(x))), 0) AS a,
  length(hits[i]) AS n, length(kept[i]) AS k FROM m),
g AS (SELECT rid, {counts}, coalesce(string_agg(kind || ':' || CAST(a AS BIGINT) || ':' || CAST(a + n AS BIGINT), ',' ORDER BY a, ord) FILTER (ord IN ({bases})), '') AS b,
  string_agg(kind || ':' || CAST(a AS BIGINT) || ':' || CAST(a + n AS BIGINT), ',' ORDER BY a, ord) AS spans
  FROM s WHERE k >= CASE ord {least} END GROUP BY rid)
SELECT t.doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in rules if r.base)}, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN g USING (rid)"""
