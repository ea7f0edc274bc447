"""Operator 5, secret scans with multipart credential linking [native: DataFrame functions only].

Base kinds are reported wherever they match. Weak kinds are too common to report alone: they are candidates, and an
interval join within the scope of a document reports a candidate only where a complementary part lies within REACH
code points: an access identifier beside a bare secret, a secret beside a user name or an endpoint with a login, an
endpoint beside a user name or a secret.

Positions come from two built-in functions: split() gives the gaps between the matches of a pattern, and
regexp_extract_all() the matches; the running totals of their lengths are the spans. Every pattern is linear in the
text, and a text without a pattern's marks isn't searched for it.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.shared import materialise, text_or_empty

#: Base kinds: pattern, the group whose length counts, least length, marks of which every match has one. Runs are matched
#: whole or not at all, so the least length of an access identifier or of hex digits may stand in the pattern.
BASE = {
    "assign": (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12, (":", "=")),
    "access": (r"AKIA[A-Z0-9]{14,}", 0, 18, ("AKIA",)),
    "hex": (r"[0-9a-f]{16,}", 0, 16, ()),
}
#: Weak kinds: pattern, least length of the match, the part of a credential it is, marks. A scheme has 31 letters at most.
WEAK = {
    "weak_id": (r"(?:ASIA|AROA|AIDA)[A-Z0-9]+", 16, "id", ("ASIA", "AROA", "AIDA")),
    "weak_user": (r"(?i:user(?:name)?|login|client_?id|account)\x20*[:=]\x20*[A-Za-z0-9@._-]+", 6, "id", (":", "=")),
    "weak_secret": (r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])[A-Za-z0-9+/_=-]{20,}", 20, "secret", ()),
    "weak_endpoint": (r"(?<![A-Za-z])(?i:[a-z][a-z0-9+.-]{0,30})://[A-Za-z0-9._~:@/?#%=&+-]+", 10, "endpoint", ("://",)),
}
KINDS = [*BASE, *WEAK]
#: The scope: parts of one credential lie within so many code points of each other.
REACH = 200


#: Elements that a running total copies at a time.
CHUNK = 256


def running(steps: Column) -> Column:
    """The total before each element of an array of int, chunk by chunk: a long array isn't copied for each element."""

    def before(xs: Column, first: Column) -> Column:
        start = F.struct(first.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(xs, start, lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")))["out"]

    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / F.lit(CHUNK)).cast("int")), lambda c: F.slice(steps, c * CHUNK + 1, CHUNK))
    sums = F.transform(chunks, lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x))
    whole = F.flatten(F.zip_with(chunks, before(sums, F.lit(0)), before))
    return F.when(F.size(steps) > 0, whole).otherwise(F.array().cast("array<int>"))


def spans_of(whole: Column, counted: Column, gaps: Column, least: int) -> Column:
    """array<struct<s, e>> of the matches whose group has least or more code points; none where nothing matches.

    whole: the code points of each match, counted: of its group; gaps: of what lies before each match and after the last.
    """
    ahead = F.slice(gaps, 1, F.size(whole))
    start = F.zip_with(running(F.zip_with(ahead, whole, lambda g, n: g + n)), ahead, lambda a, g: a + g)
    spans = F.transform(F.arrays_zip(start.alias("s"), whole.alias("n"), counted.alias("g")), lambda x: F.struct(x["s"].alias("s"), (x["s"] + x["n"]).alias("e"), x["g"].alias("g")))
    fit = F.transform(F.filter(spans, lambda x: x["g"] >= least), lambda x: F.struct(x["s"], x["e"]))
    return F.coalesce(fit, F.array().cast("array<struct<s:int,e:int>>"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row_no, doc_id, one array of spans for each kind); texts end here."""
    rules = {k: (p, g, n, marks) for k, (p, g, n, marks) in BASE.items()} | {k: (p, 0, n, marks) for k, (p, n, _, marks) in WEAK.items()}
    rows = docs.select(F.monotonically_increasing_id().alias("row_no"), docs[id_col].alias("doc_id"), text_or_empty(docs[text_col]).alias("text"))
    text = F.col("text")
    for step in ("hit", "found", "sizes", "spans"):  # each a projection of its own, so that no pattern runs twice
        new = {}
        for k, (pattern, group, least, marks) in rules.items():
            matches = lambda g, p=pattern: F.regexp_extract_all(text, F.lit(p), F.lit(g))
            if step == "hit":
                marked = [F.contains(text, F.lit(m)) for m in marks] or [F.lit(True)]
                new[f"{k}_hit"] = reduce(or_, marked) & text.rlike(pattern)
            elif step == "found":
                hit = F.col(f"{k}_hit")
                new |= {f"{k}_whole": F.when(hit, matches(0)), f"{k}_gaps": F.when(hit, F.split(text, pattern, -1))}
                if group:
                    new[f"{k}_counted"] = F.when(hit, matches(group))
            elif step == "sizes":
                new |= {f"{k}_{part}": F.transform(f"{k}_{part}", lambda w: F.length(w)) for part in ("whole", "gaps", *["counted"] * bool(group))}
            else:
                new[k] = spans_of(F.col(f"{k}_whole"), F.col(f"{k}_counted" if group else f"{k}_whole"), F.col(f"{k}_gaps"), least)
        rows = rows.withColumns(new)
    return rows.select("row_no", "doc_id", *KINDS)


def linked(found: DataFrame, reach: int = REACH) -> DataFrame:
    """(row_no, kind, s, e) of the weak candidates that a complementary part lies beside.

    The interval join: a part and its complement don't overlap, so the start of one lies within reach of the other's
    end. A candidate goes to the cells of `reach` code points of its start and of its end, a part to the two cells in
    which such a start or end can lie; equal cells are joined, the distance is checked. So spans may have any length.
    It is a semi-join, and a candidate that both ends find comes out once.
    """
    has = lambda *kinds: sum((F.size(k) for k in kinds), F.lit(0)) > 0
    busy = found.filter(has(*WEAK))
    part = lambda k, r: F.transform(k, lambda x: F.struct(F.lit(k).alias("kind"), F.lit(r).alias("role"), x["s"].alias("s"), x["e"].alias("e")))
    label = lambda kinds: F.concat(*[part(k, r) for k, r in kinds])
    weak = [(k, r) for k, (_, _, r, _) in WEAK.items()]
    exploded = lambda kinds: busy.select("row_no", F.explode(label(kinds)).alias("x")).select("row_no", "x.*")
    cell = lambda x: F.floor(x / max(1, reach))
    side = lambda name, c: F.struct(F.lit(name).alias("side"), c.alias("cell"))
    ends = F.array(side("end", cell(F.col("e"))), side("start", cell(F.col("s"))))
    candidates = exploded(weak).withColumn("at", F.explode(ends)).select("row_no", "kind", "role", "s", "e", "at.side", "at.cell")
    parts = exploded([*weak, ("access", "id"), ("assign", "secret"), ("hex", "secret")])
    parts = parts.select("row_no", F.col("role").alias("p_role"), F.col("s").alias("p_s"), F.col("e").alias("p_e"))
    begins, stops = cell(F.col("p_s")), cell(F.col("p_e"))
    places = F.array(side("end", begins - 1), side("end", begins), side("start", stops), side("start", stops + 1))
    parts = parts.withColumn("at", F.explode(places)).select("row_no", "p_role", "p_s", "p_e", "at.side", "at.cell")
    near = (F.col("p_s") <= F.col("e") + reach) & (F.col("p_e") >= F.col("s") - reach)
    apart = (F.col("p_s") >= F.col("e")) | (F.col("p_e") <= F.col("s"))  # a part isn't its own complement
    same = (candidates.row_no == parts.row_no) & (candidates.side == parts.side) & (candidates.cell == parts.cell)
    return candidates.join(parts, same & (F.col("role") != F.col("p_role")) & near & apart, "left_semi").select("row_no", "kind", "s", "e").distinct()


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> DataFrame:
    """(doc_id, base, all): arrays of struct<s, kind, e> in order of start, then of kind as listed in KINDS.

    Null and empty texts have no spans. Every input row gives one row, repeated rows and rows without id too; extra
    columns are ignored.
    """
    found = materialise(scan(docs, id_col, text_col), "secret-spans")
    more = linked(found, reach).groupBy("row_no").agg(F.collect_list(F.struct("kind", "s", "e")).alias("more"))
    rank = {k: i for i, k in enumerate(KINDS)}
    span = lambda kind, i, x: F.struct(x["s"].alias("s"), i.alias("rank"), x["e"].alias("e"), kind.alias("kind"))
    of_kind = lambda k: F.transform(k, lambda x: span(F.lit(k), F.lit(rank[k]), x))
    base = F.concat(*[of_kind(k) for k in BASE])
    number = F.create_map(*[F.lit(v) for kv in rank.items() for v in kv])
    linked_spans = F.transform("more", lambda x: span(x["kind"], number[x["kind"]], x))
    both = found.join(more, "row_no", "left").withColumn("base", F.array_sort(base))
    return both.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE], "base", F.when(F.col("more").isNull(), F.col("base")).otherwise(F.array_sort(F.concat(F.col("base"), linked_spans))).alias("all"))


def secret_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns, taken from the spans of find_secrets()."""
    joined = lambda c: F.concat_ws(",", F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))))
    found = find_secrets(docs)
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(joined("base"), 256).alias("base_sha256"), joined("all").alias("spans"))
