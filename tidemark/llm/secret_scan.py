"""Secret scans by a trigram inverted index, with DataFrame operations only."""

from __future__ import annotations

import re
from dataclasses import dataclass

try:
    from re import _constants as sre
    from re import _parser as parser
except ImportError:  # before Python 3.11
    import sre_constants as sre
    import sre_parse as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import key_of, parts, stage, whole

#: Strings that a part of a pattern may stand for while they are still listed one by one.
MOST_STRINGS = 64
#: Rows of a shard of the index by plan, and candidates up to which they are broadcast (a key and some small numbers each).
SHARD_ROWS, BROADCAST_ROWS = 8192, 250_000


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a pattern, and the least length of one of its groups (0: the match)."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


# The contract's three kinds.
BASE = (
    Rule("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
# Public formats of further credentials.
ADDED = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 20),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+[.]eyJ[A-Za-z0-9_-]+[.][A-Za-z0-9_-]+", 0, 40),
)
RULES = BASE + ADDED

TRUE = ("true",)


def _flat(op, parts):
    return list(dict.fromkeys(x for p in parts for x in (p[1:] if p[0] == op else [p])))


def _all(parts):
    parts = _flat("and", [p for p in parts if p != TRUE])
    return TRUE if not parts else parts[0] if len(parts) == 1 else ("and", *parts)


def _any(parts):
    """An alternative that asks for all that another asks for, and more, adds nothing."""
    if TRUE in parts:
        return TRUE
    parts = _flat("or", parts)
    asks = {p: frozenset(p[1:]) if p[0] == "and" else frozenset([p]) for p in parts}
    parts = [p for p in parts if not any(asks[q] < asks[p] for q in parts)]
    return parts[0] if len(parts) == 1 else ("or", *parts)


def _grams(strings) -> tuple:
    """What a text must hold if it holds one of the strings."""
    return _any([_all([("gram", s[i : i + 3]) for i in range(len(s) - 2)]) for s in sorted(strings)])


def _sequence(items) -> tuple[set[str] | None, tuple]:
    """The strings that a sequence can stand for (None: too many), and its trigram query."""
    run, needs, whole = {""}, [], True
    for op, arg in items:
        strings, need = _node(op, arg)
        if strings is not None and len(run) * len(strings) <= MOST_STRINGS:
            run = {a + b for a in run for b in strings}
            continue
        needs += [_grams(run), need]
        run, whole = (strings if strings is not None and len(strings) <= MOST_STRINGS else {""}), False
    needs.append(_grams(run))
    return (run if whole else None), _all(needs)


def _node(op, arg) -> tuple[set[str] | None, tuple]:
    if op is sre.LITERAL:
        return {chr(arg).lower()}, TRUE
    if op is sre.IN:
        listed = {chr(a).lower() for o, a in arg if o is sre.LITERAL}
        return (listed, TRUE) if all(o is sre.LITERAL for o, _ in arg) and len(listed) <= 8 else (None, TRUE)
    if op is sre.SUBPATTERN:
        return _sequence(arg[-1])
    if op is sre.BRANCH:
        found = [_sequence(x) for x in arg[1]]
        strings = None if any(s is None for s, _ in found) else set().union(*(s for s, _ in found))
        return (strings if strings is not None and len(strings) <= MOST_STRINGS else None), _any([n for _, n in found])
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        least, most, body = arg
        strings, need = _sequence(body)
        if most == 1 and least == 0 and strings is not None:
            return strings | {""}, TRUE
        if least == most == 1:
            return strings, need
        return None, need if least else TRUE
    return None, TRUE


def trigram_query(pattern: str) -> tuple:
    """A Boolean query over lower-case trigrams that every text with a match satisfies: TRUE, ("gram", g), ("and", ...) or ("or", ...)."""
    return _sequence(parser.parse(pattern))[1]


def grams_of(query: tuple) -> set[str]:
    return {query[1]} if query[0] == "gram" else set().union(*(grams_of(q) for q in query[1:])) if query != TRUE else set()


def _rows(query: tuple, found: Column) -> Column:
    """The rows that satisfy a trigram query; ``found`` is a shard's index, a map from trigram to sorted rows."""
    none = F.array().cast("array<bigint>")
    if query[0] == "gram":
        return F.coalesce(F.try_element_at(found, F.lit(query[1])), none)
    held = [_rows(q, found) for q in query[1:]]
    out = held[0]
    for x in held[1:]:
        out = F.array_intersect(out, x) if query[0] == "and" else F.array_union(out, x)
    return out


def inverted_index(docs: DataFrame, row: str, text: str, grams: list[str], shards: int) -> DataFrame:
    """The index over the trigrams that queries can ask for: a row (shard, grams) with a map from trigram to posting list.

    A text is lower-cased once and asked for each of these few trigrams, which takes a fifth of the time of one pattern
    of them all. Rows are dealt into shards by their key, so a frequent trigram has a bounded list in each shard
    instead of a long one.
    """
    low = docs.select(F.col(row).alias("row"), F.lower(F.col(text)).alias("low"))
    held = F.filter(F.array(*map(F.lit, grams)), lambda g: F.contains(F.col("low"), g))
    read = low.select("row", F.explode(held).alias("gram"))
    lists = read.groupBy(F.pmod("row", F.lit(shards)).alias("shard"), "gram").agg(F.sort_array(F.collect_set("row")).alias("rows"))
    return lists.groupBy("shard").agg(F.map_from_entries(F.collect_list(F.struct("gram", "rows"))).alias("grams"))


def candidates(index: DataFrame, queries: list[tuple]) -> DataFrame:
    """Rows (row, rules): which of the trigram queries a row satisfies, from intersected and merged posting lists."""
    listed = [F.struct(F.lit(i).alias("rule"), _rows(q, F.col("grams")).alias("rows")) for i, q in enumerate(queries) if q != TRUE]
    each = index.select(F.explode(F.array(*listed)).alias("x")).select("x.rule", F.explode("x.rows").alias("row"))
    return each.groupBy("row").agg(F.collect_list("rule").alias("rules"))


def spans_of(text: Column, kind: str, rule: Rule, order: int) -> Column:
    """Array of (s, o, kind, e): the rule's leftmost matches without overlap, in code points.

    Each match is extracted together with the gap before it, so running lengths give the places.
    """
    groups = re.compile(rule.pattern).groups
    pattern = F.lit(rf"(?s)\G.*?({rule.pattern})")
    whole, match = F.regexp_extract_all(text, pattern, F.lit(0)), F.regexp_extract_all(text, pattern, F.lit(1))
    value = F.regexp_extract_all(text, pattern, F.lit(1 + rule.group)) if rule.group and groups else match
    steps = F.arrays_zip(
        F.transform(whole, lambda x: F.length(x)).alias("w"),
        F.transform(match, lambda x: F.length(x)).alias("m"),
        F.transform(value, lambda x: F.length(x)).alias("v"),
    )
    empty = F.array().cast("array<struct<s:int,o:int,kind:string,e:int>>")
    folded = F.aggregate(
        steps,
        F.struct(F.lit(0).alias("at"), empty.alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + x["w"]).alias("at"),
            F.when(
                x["v"] >= rule.least,
                F.concat(acc["out"], F.array(F.struct((acc["at"] + x["w"] - x["m"]).alias("s"), F.lit(order).alias("o"), F.lit(kind).alias("kind"), (acc["at"] + x["w"]).alias("e")))),
            ).otherwise(acc["out"]).alias("out"),
        ),
    )
    return folded["out"]


def _bounded(rule: Rule) -> Rule:
    """A run of one character class with a least length: the length goes into the pattern, which finds the same maximal runs."""
    if not rule.group and rule.pattern in ("[0-9a-f]+",):
        return Rule(rule.kind, rule.pattern[:-1] + f"{{{rule.least},}}")
    return rule


def scan(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with column spans: array of (s, o, kind, e) by start, then rule order; code points, end exclusive.

    Each pattern gives a Boolean trigram query. An inverted index, in shards of about SHARD_ROWS rows, lists the rows of
    each trigram in these queries; its lists are intersected and merged into candidates, and a rule's pattern runs over
    its candidates alone; rules without a mandatory trigram run over every text. Only row keys and trigrams travel,
    and candidates come back to the texts by broadcast, as long as there are at most BROADCAST_ROWS of them, else by a
    join on the key. The key is a hash of the whole row, so a collision only adds a candidate and repeated rows each
    get their spans. Null and empty texts have no spans, rows are kept one to one, and a column named spans is replaced.
    Extra columns pass through, whatever their names.
    """
    queries = [trigram_query(r.pattern) for r in rules]
    grams = sorted(set().union(*map(grams_of, queries)))
    kept = [c for c in docs.columns if c.lower() != "spans"]
    keyed = docs.select(whole(docs, kept), F.col(text).alias("text"), key_of(docs, kept).alias("key"))
    asked = F.array().cast("array<int>")
    if grams:
        index = inverted_index(keyed, "key", "text", grams, docs.count() // SHARD_ROWS + 1)
        found = stage(candidates(index, queries))
        found = F.broadcast(found) if found.count() <= BROADCAST_ROWS else found
        keyed = keyed.join(found, F.col("key") == F.col("row"), "left")
        asked = F.coalesce("rules", asked)
    none = F.array().cast("array<struct<s:int,o:int,kind:string,e:int>>")
    spans = []
    for i, (rule, query) in enumerate(zip(rules, queries, strict=True)):
        own = _bounded(rule)
        due = F.col("text").rlike(own.pattern) if query == TRUE else F.array_contains(asked, i)
        spans.append(F.coalesce(F.when(due, spans_of(F.col("text"), rule.kind, own, i)), none))
    return keyed.select(*parts(kept), F.array_sort(F.concat(*spans)).alias("spans"))


def redact(scanned: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """Replace what the spans cover (overlapping spans as one) by ``mark``; drops spans."""
    t, start = F.col(text), F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    folded = F.aggregate(
        "spans",
        start,
        lambda acc, x: F.when(
            x["s"] >= acc["at"],
            F.struct(x["e"].alias("at"), F.concat(acc["out"], F.substring(t, acc["at"] + 1, x["s"] - acc["at"]), F.lit(mark)).alias("out")),
        ).otherwise(F.struct(F.greatest(acc["at"], x["e"]).alias("at"), acc["out"].alias("out"))),
    )
    kept = [c for c in scanned.columns if c != "spans"]
    done = scanned.select(whole(scanned, kept), F.col(text).alias("t"), F.when(F.size("spans") > 0, folded).alias("f"))
    clean = F.when(F.col("f").isNull(), F.col("t")).otherwise(F.concat("f.out", F.substring(F.col("t"), F.col("f.at") + 1, F.length("t"))))
    return done.select(*[clean.alias(c) if c == text else p for c, p in zip(kept, parts(kept), strict=True)])


def digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def query(spark, sf_dir: str) -> DataFrame:
    from .common import read_table

    base = [r.kind for r in BASE]
    done = scan(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    return done.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in base],
        F.sha2(digest(F.filter("spans", lambda x: x["kind"].isin(*base))), 256).alias("base_sha256"),
        digest(F.col("spans")).alias("spans"),
    )


def _sql() -> str:
    parts = []
    for i, rule in enumerate(RULES):
        pattern = f"(?s).*?({rule.pattern})".replace("'", "''")
        parts.append(
            f"SELECT doc_id, {i} AS o, '{rule.kind}' AS kind, unnest(list_transform(range(1, len(w) + 1), lambda i: "
            f"{{'e': list_sum(list_transform(w[1:i], lambda x: length(x)))::BIGINT, 'm': length(m[i])::BIGINT, 'v': length(v[i])::BIGINT}})) AS p FROM ("
            f"SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{pattern}', 0) AS w, regexp_extract_all(coalesce(text, ''), '{pattern}', 1) AS m, "
            f"regexp_extract_all(coalesce(text, ''), '{pattern}', {1 + rule.group}) AS v FROM documents)"
        )
    kept = " OR ".join(f"(o = {i} AND p.v >= {r.least})" for i, r in enumerate(RULES))
    kinds = ", ".join(f"'{r.kind}'" for r in BASE)
    one = "kind || ':' || (p.e - p.m) || ':' || p.e"
    counts = ", ".join(f"count(o) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in BASE)
    return (
        f"WITH f AS ({' UNION ALL '.join(parts)}), k AS (SELECT * FROM f WHERE {kept}) "
        f"SELECT d.doc_id, {counts}, sha256(coalesce(string_agg({one}, ',' ORDER BY p.e - p.m, o) FILTER (kind IN ({kinds})), '')) AS base_sha256, "
        f"coalesce(string_agg({one}, ',' ORDER BY p.e - p.m, o) FILTER (o IS NOT NULL), '') AS spans "
        "FROM documents d LEFT JOIN k ON d.doc_id = k.doc_id GROUP BY d.doc_id"
    )


SQL = _sql()
