"""Merkle fingerprints of documents (operator 1, DataFrame functions only).

A text is cut into sections (after blank lines), paragraphs (after line ends) and
sentences (after a stop and white space); nothing is dropped, so the parts joined are
the text.  Each sentence is hashed by SHA-256, a paragraph by its sentences' hashes, a
section by its paragraphs', and the root by its sections', the text's length and its
digest.  Equal roots mean equal texts; where roots differ, following the differing
branches leads to the edited paragraphs (`edited_branches`).

The fingerprint string holds the tree: root|section:paragraph=leaf.leaf,paragraph=...|...
with the root in full, inner nodes cut to 16 and leaves to 12 hexadecimal digits.  The
likeness of two fingerprints is the share of their different leaves that both have.

Defined cases: a null text is empty; an empty text has a root and no section; two
fingerprints without leaves are alike (1).  A null doc_id comes first in the order of
documents, rows of one doc_id follow each other by a hash of their texts, and the last
row's next is the first.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litloom.llm.common import NULL_ID, partitions_for, table

#: Bytes of text in one range of ids; ranges are found by approximate percentiles.
RANGE_BYTES = 4 << 20
MAX_RANGES = 20_000
LEAST = -(2**63)
CUT = "\x01"


def _parts(text: Column, pattern: str) -> Column:
    """The text's pieces, each up to and with a match of the pattern; a CUT in the text also parts."""
    return F.filter(F.split(F.regexp_replace(text, f"({pattern})", f"$1{CUT}"), CUT), lambda x: x != "")


def tree(text: Column) -> Column:
    """array<section: array<paragraph: array<leaf hash>>>."""
    return F.transform(
        _parts(text, r"\n[ \t]*\n"),
        lambda s: F.transform(_parts(s, r"\n"), lambda p: F.transform(_parts(p, r"[.!?][ \t\n]"), lambda x: F.sha2(x, 256))),
    )


def _paragraph_hash(p: Column) -> Column:
    return F.sha2(F.concat(F.lit("p"), F.concat_ws("", p)), 256)


def _section_hash(s: Column) -> Column:
    return F.sha2(F.concat(F.lit("s"), F.concat_ws("", F.transform(s, _paragraph_hash))), 256)


def root(text: Column, t: Column) -> Column:
    return F.sha2(F.concat(F.lit("r"), F.char_length(text).cast("string"), F.concat_ws("", F.transform(t, _section_hash)), F.sha2(text, 256)), 256)


def encoded(text: Column, t: Column) -> Column:
    """The fingerprint string of a text and its tree."""
    section = lambda s: F.concat(
        F.substring(_section_hash(s), 1, 16),
        F.lit(":"),
        F.concat_ws(",", F.transform(s, lambda p: F.concat(F.substring(_paragraph_hash(p), 1, 16), F.lit("="), F.concat_ws(".", F.transform(p, lambda x: F.substring(x, 1, 12)))))),
    )
    return F.concat_ws("|", F.array_insert(F.transform(t, section), 1, root(text, t)))


def leaves(fingerprint: Column) -> Column:
    """Leaf hashes of a fingerprint string: they alone follow = or a stop."""
    return F.regexp_extract_all(fingerprint, F.lit("[=.]([0-9a-f]{12})"), 1)


def likeness(a: Column, b: Column) -> Column:
    """Of two fingerprint strings, 0 to 1."""
    x, y = leaves(a), leaves(b)
    both, either = F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)


def edited_branches(a: Column, b: Column) -> Column:
    """Of two fingerprint strings: the paragraphs (section, paragraph, both from 1) of b that a does not have."""
    paragraphs = lambda s: F.split(F.element_at(F.split(s, ":"), 2), ",")
    tail = lambda f: F.slice(F.split(f, r"\|"), 2, F.greatest(F.size(F.split(f, r"\|")) - 1, F.lit(0)))
    known = F.flatten(F.transform(tail(a), paragraphs))
    found = F.flatten(F.transform(tail(b), lambda s, i: F.transform(paragraphs(s), lambda p, j: F.struct((i + 1).alias("section"), (j + 1).alias("paragraph"), p.alias("node")))))
    same_root = F.element_at(F.split(a, r"\|"), 1) == F.element_at(F.split(b, r"\|"), 1)
    missing = F.transform(F.filter(found, lambda x: ~F.array_contains(known, x["node"])), lambda x: F.struct(x["section"].alias("section"), x["paragraph"].alias("paragraph")))
    return F.when(same_root, F.slice(missing, 1, 0)).otherwise(missing)


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with fingerprint added."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumn("__tree", tree(whole)).withColumn("fingerprint", encoded(whole, F.col("__tree"))).drop("__tree")


def _last_at_most(values: list[int], key: Column) -> Column:
    """The place, from 0, of the last of the sorted values that is at most key; looked up in two steps of some sqrt(len(values))."""
    step = max(1, round(len(values) ** 0.5))
    lit = lambda e: F.lit(e).cast("long")
    rows = [values[i : i + step] for i in range(0, len(values), step)]
    coarse = F.size(F.filter(F.array(*[lit(r[0]) for r in rows]), lambda e: e <= key))
    fine = F.size(F.filter(F.element_at(F.array(*[F.array(*map(lit, r)) for r in rows]), coarse), lambda e: e <= key))
    return ((coarse - 1) * step + fine - 1).cast("int")


def _number(edges: list[tuple[int, list[int]]]) -> Column:
    """The range of a row: edges are ids, each with the ties that its own rows are parted at (one: not parted)."""
    place = _last_at_most([k for k, _ in edges], F.col("__key"))
    first, total = [], 0
    for _, ties in edges:
        first.append(total)
        total += len(ties)
    parted = [(k, t) for k, t in edges if len(t) > 1]
    base = F.element_at(F.array(*map(F.lit, first)), place + 1)
    after = F.element_at(F.array(*[F.lit(f + len(t) - 1) for f, (_, t) in zip(first, edges)]), place + 1)
    if not parted:
        return base
    own = F.create_map(*[x for k, t in parted for x in (F.lit(k).cast("long"), F.array(*[F.lit(v).cast("long") for v in t]))])[F.col("__key")]
    at = F.element_at(F.array(*[F.lit(k).cast("long") for k, _ in edges]), place + 1) == F.col("__key")
    return F.when(at & own.isNotNull(), base + F.size(F.filter(own, lambda t: t <= F.col("__tie"))) - 1).otherwise(after).cast("int")


def _edges(docs: DataFrame, n: int) -> list[tuple[int, list[int]]]:
    """Ids at which ranges begin.  An id that fills several ranges is parted by the tie of its rows, at ties that rows have."""
    found = docs.agg(F.min("__key").alias("low"), F.percentile_approx("__key", [i / n for i in range(1, n)], max(10_000, 4 * n)).alias("e")).first()
    if found["low"] is None:
        return []
    times = Counter([int(found["low"]), *map(int, found["e"] or [])])
    edges = [(k, [LEAST + j * (2**64 // m) for j in range(m)]) for k, m in sorted(times.items())]
    if max(times.values()) > 2:
        parted = [k for k, m in times.items() if m > 1]
        rows = docs.where(F.col("__key").isin(parted)).groupBy("__key", _number(edges).alias("r")).agg(F.min("__tie").alias("t")).collect()
        ties: dict[int, list[int]] = {}
        for r in sorted(rows, key=lambda r: (r["__key"], r["t"])):
            ties.setdefault(r["__key"], []).append(r["t"])
        return [(k, ties.get(k, t)) for k, t in edges]
    return [(k, t[:1]) for k, t in edges]


def with_next(docs: DataFrame, carried: list[str]) -> DataFrame:
    """docs (with __key and __tie to order by) with __next: the carried columns of the next row, the first one's for the last.

    Rows are dealt to ranges of ids, and of ties where an id has very many rows; the first row
    of a range (all rows of its id, where the id is not parted) is also sent to the range
    before, the very first to the last, so each range finds its last row's next itself.
    """
    size = docs.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"]
    n = min(MAX_RANGES, partitions_for(size, RANGE_BYTES, 8))
    edges = _edges(docs, n)
    if not edges:
        return docs.withColumn("__next", F.struct(*carried)).where("false")
    total = sum(len(t) for _, t in edges)
    pairs = F.create_map(*[x for k, t in edges if len(t) > 1 for x in (F.lit(k).cast("long"), F.array(*[F.lit(v).cast("long") for v in t]))]) if total > len(edges) else None
    place = _last_at_most([k for k, _ in edges], F.col("__key"))
    first = F.element_at(F.array(*[F.lit(k).cast("long") for k, _ in edges]), place + 1) == F.col("__key")
    if pairs is not None:
        first = first & F.coalesce(F.array_contains(pairs[F.col("__key")], F.col("__tie")), F.lit(True))
    dealt = docs.withColumn("__range", _number(edges)).withColumn("__first", first)
    before = F.struct(F.pmod(F.col("__range") - 1, F.lit(total)).cast("int").alias("to"), F.lit(1).alias("guest"))
    home = F.struct(F.col("__range").alias("to"), F.lit(0).alias("guest"))
    dealt = dealt.withColumn("__at", F.explode(F.when(F.col("__first"), F.array(home, before)).otherwise(F.array(home))))
    dealt = dealt.withColumns({"__to": F.col("__at.to"), "__guest": F.col("__at.guest")})
    order = Window.partitionBy("__to").orderBy("__guest", "__key", "__tie")
    out = dealt.withColumn("__next", F.lead(F.struct(*carried)).over(order)).where("__guest = 0")
    return out.drop("__range", "__first", "__at", "__to", "__guest")


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint against that of its edited text and of the next document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.withColumns({"__key": F.coalesce("doc_id", F.lit(NULL_ID)), "__tie": F.xxhash64("text")})
    rows = with_next(fingerprints(rows), ["text", "fingerprint"])
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("__next.text"), F.lit(1), half)))
    rows = rows.withColumn("__edited_tree", tree(F.col("edited")))
    rows = rows.withColumn("edited_fingerprint", encoded(F.col("edited"), F.col("__edited_tree")))
    return rows.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("__next.fingerprint")).alias("near_next"),
    )


def op1_merkle_fingerprints(spark, sf_dir: str) -> DataFrame:
    return compare_with_edits(table(spark, sf_dir, "documents"))


def _sql_parts(text: str, pattern: str) -> str:
    return f"list_filter(string_split(regexp_replace({text}, '({pattern})', '\\1' || chr(1), 'g'), chr(1)), lambda z: z <> '')"


def _sql_tree(text: str) -> str:
    sentences = f"list_transform({_sql_parts('p', '[.!?][ \\t\\n]')}, lambda x: sha256(x))"
    paragraphs = f"list_transform({_sql_parts('s', '\\n')}, lambda p: {sentences})"
    return f"list_transform({_sql_parts(text, '\\n[ \\t]*\\n')}, lambda s: {paragraphs})"


_P = "sha256('p' || array_to_string(p, ''))"
_S = "sha256('s' || array_to_string(list_transform(s, lambda p: sha256('p' || array_to_string(p, ''))), ''))"


def _sql_encoded(text: str, t: str) -> str:
    whole = f"sha256('r' || length({text}) || array_to_string(list_transform({t}, lambda s: {_S}), '') || sha256({text}))"
    para = f"left({_P}, 16) || '=' || array_to_string(list_transform(p, lambda x: left(x, 12)), '.')"
    section = f"'|' || left({_S}, 16) || ':' || array_to_string(list_transform(s, lambda p: {para}), ',')"
    return f"{whole} || array_to_string(list_transform({t}, lambda s: {section}), '')"


def _sql_likeness(a: str, b: str) -> str:
    union = f"len(list_distinct(list_concat({a}, {b})))"
    return f"case when {union} = 0 then 1.0::double else len(list_distinct(list_intersect({a}, {b}))) / {union} end"


_LEAVES = "list_transform(flatten(flatten({t})), lambda x: left(x, 12))"

SQL = {
    "op1_merkle_fingerprints": f"""
with base as (select doc_id, coalesce(text, '') as text from documents),
seq as (select doc_id, text, coalesce(lead(text) over (order by doc_id), first_value(text) over (order by doc_id)) as nxt from base),
edit as (select *, left(text, (length(text) - length(text) // 2)::int) || left(nxt, (length(text) // 2)::int) as edited from seq),
trees as (select *, {_sql_tree('text')} as t, {_sql_tree('edited')} as et from edit),
out as (select *, {_LEAVES.format(t='t')} as l, {_LEAVES.format(t='et')} as el from trees),
fin as (select *, coalesce(lead(l) over (order by doc_id), first_value(l) over (order by doc_id)) as nl from out)
select doc_id, length(text)::bigint as n_chars, sha256(edited) as edited_sha256, {_sql_encoded('text', 't')} as fingerprint,
{_sql_encoded('edited', 'et')} as edited_fingerprint, {_sql_likeness('l', 'el')} as near_edited, {_sql_likeness('l', 'nl')} as near_next
from fin""",
}

QUERIES = {"op1_merkle_fingerprints": op1_merkle_fingerprints}
