"""Line dedup with a tree of line templates. SQL functions only.

A line goes down a tree of fixed depth: by its number of tokens, then by its leading tokens, where a token with a digit
is a variable field. In a leaf that several documents reach, the rest of the line is cut into segments; a segment that
recurs in the leaf is fixed, any other is variable. A line has two templates: all of it (of a short line, its tokens), and,
if it is mostly fixed, its leaf with the fixed segments. A template is boilerplate if it recurs in documents that are unlike each other, and is
then dropped from all texts but the one of the smallest id.

Documents are unlike each other if they have a text of their own. One whose tokens are to ``COPIED`` or more in lines that
other documents have as well may be a copy; all such documents together count once for a template, so that lines recurring
in copies of one document alone stay. Near-duplicate documents are another operator's matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.session import written

#: Leading tokens of the tree; segments of the rest; tokens of a line, at least, for a template with variable segments.
DEPTH, SEGMENTS, LEAST_TOKENS = 4, 8, 6
#: Documents that make a template recur, and so many for equal lines of LEAST_TOKENS or more.
LEAST_DOCS, LEAST_EQUAL = 3, 2
#: Share of a line's tokens that must be fixed, and of a document's tokens in recurring lines that make it a copy.
FIXED_SHARE, COPIED = 0.6, 0.8
#: A key of more than this share of all lines is joined in place, to a broadcast; there are at most as many as its inverse.
HOT_SHARE = 0.001

VARIABLE = r"[^\x20\x09-\x0D0-9]*[0-9][^\x20\x09-\x0D]*"
SPACE = r"[\x20\x09-\x0D]+"
WHITE = " \t\n\x0b\x0c\r"


def tokens(line: Column) -> Column:
    """Tokens of a line; those with a digit are ``<*>``."""
    masked = F.when(line.rlike("[0-9]"), F.regexp_replace(line, VARIABLE, "<*>")).otherwise(line)
    return F.filter(F.split(masked, SPACE), lambda t: t != "")


def segments(words: Column, depth: int = DEPTH, count: int = SEGMENTS) -> Column:
    """The tokens after the leading ones, in ``count`` runs as even as they can be: structs of nth, size and hash."""
    rest = F.greatest(F.size(words) - depth, F.lit(0))

    def before(i: int) -> Column:
        return ((rest * i - F.pmod(rest * i, F.lit(count))) / count).cast("int")

    def cut(i: int) -> Column:
        size = before(i + 1) - before(i)
        return F.struct(F.lit(i).alias("nth"), size.alias("size"),
                        F.xxhash64(F.slice(words, before(i) + depth + 1, size)).alias("hash"))

    return F.array(*[cut(i) for i in range(count)])  # written out: a lambda over the segments takes four times as long


def _joined(rows: DataFrame, known: DataFrame, keys: list[str], how: str, hot: Column) -> DataFrame:
    """``rows`` joined to ``known`` (one row a key) without shuffling the rows of the ``hot`` keys, 1 / HOT_SHARE at most."""
    most = F.broadcast(known.filter(hot))
    rest = rows.join(most.select(*keys), keys, "left_anti").join(known.filter(~hot), keys, how)
    return rows.join(most, keys, "inner" if how == "left" else how).unionByName(rest)


def recurring_lines(docs: DataFrame, least_tokens: int = LEAST_TOKENS, depth: int = DEPTH, count: int = SEGMENTS,
                    least_docs: int = LEAST_DOCS, least_equal: int = LEAST_EQUAL, fixed_share: float = FIXED_SHARE,
                    copied: float = COPIED) -> DataFrame:
    """Lines of ``docs`` (doc_id, h, text) to drop: doc_id, h and ``nth``, the line's place in its text from 0."""
    least_tokens = max(least_tokens, depth)
    placed = F.transform(F.split("text", "\n"), lambda x: F.struct(
        tokens(x).alias("words"), F.xxhash64(F.btrim(x, F.lit(WHITE))).alias("line")))
    lines = docs.select("doc_id", "h", F.posexplode(placed).alias("nth", "at")).select("doc_id", "h", "nth", "at.words", "at.line")
    lines = lines.filter(F.size("words") > 0)
    equal = F.when(F.size("words") < least_tokens, F.xxhash64("words")).otherwise(F.col("line"))
    leaf = F.when(F.size("words") >= least_tokens, F.xxhash64(F.size("words"), F.slice("words", 1, depth)))
    lines = written(lines.select("doc_id", "h", "nth", F.size("words").alias("n"), equal.alias("equal"),
                                 leaf.alias("leaf"), segments(F.col("words"), depth, count).alias("parts")), "lines")
    hot = F.col("seen") > F.lit(lines.count() * HOT_SHARE)

    # Documents with a text of their own, and the lines that recur as they are.
    equal = lines.groupBy("equal", "doc_id").agg(F.count(F.lit(1)).alias("n")).groupBy("equal").agg(
        F.count("doc_id").alias("docs"), F.sum("n").alias("seen")).filter("docs > 1")
    equal = written(equal, "equal-lines")
    marked = _joined(lines.select("doc_id", "h", "nth", "n", "equal"), equal, ["equal"], "left", hot)
    own = written(marked.groupBy("doc_id", "h").agg(
        (F.sum(F.when(F.col("docs") > 1, F.col("n")).otherwise(0)) < F.sum("n") * F.lit(copied)).alias("own")), "own-texts")
    same = _joined(lines.select("doc_id", "h", "nth", "n", "equal"), equal.select("equal", "seen"), ["equal"], "inner", hot)
    same = same.select("doc_id", "h", "nth", F.xxhash64("equal", F.lit("equal")).alias("template"),
                       F.when(F.col("n") < least_tokens, F.lit(least_docs)).otherwise(F.lit(least_equal)).alias("need"))

    # Lines of leaves that several documents reach get one row for each segment; those that recur are fixed.
    leaves = lines.filter("leaf IS NOT NULL").groupBy("leaf", "doc_id").agg(F.count(F.lit(1)).alias("n")).groupBy("leaf").agg(
        F.count("doc_id").alias("docs"), F.sum("n").alias("seen")).filter(F.col("docs") >= least_docs)
    deep = lines.filter("leaf IS NOT NULL").select("doc_id", "h", "nth", "n", "leaf", "parts")
    cut = _joined(deep, written(leaves.select("leaf", "seen"), "leaves"), ["leaf"], "left_semi", hot)
    cut = written(cut.withColumn("line", F.xxhash64("doc_id", "h", "nth")), "candidates")
    part = cut.select("line", "leaf", F.explode("parts").alias("p")).select("line", "leaf", "p.nth", "p.size", "p.hash")
    part = part.filter("size > 0")
    fixed = part.groupBy("leaf", "nth", "hash").agg(F.count(F.lit(1)).alias("seen")).filter(F.col("seen") >= least_docs)
    held = _joined(part, written(fixed, "fixed"), ["leaf", "nth", "hash"], "left_semi", hot).groupBy("line").agg(
        F.sum("size").alias("held"), F.sort_array(F.collect_list(F.struct("nth", "hash"))).alias("held_parts"))
    mostly = cut.select("line", "doc_id", "h", "nth", "n", "leaf").join(held, "line", "left").filter(
        F.col("n") * F.lit(fixed_share) <= F.coalesce(F.col("held"), F.lit(0)) + F.lit(depth))
    mostly = mostly.select("doc_id", "h", "nth", F.xxhash64("leaf", "held_parts").alias("template"), F.lit(least_docs).alias("need"))

    known = same.unionByName(mostly).alias("k").join(own.alias("o"), F.expr(
        "k.doc_id <=> o.doc_id AND k.h = o.h")).select("k.*", "o.own")
    known = written(known, "templates")
    # By document first: a template of very many documents is many small partial sums.
    per_doc = known.groupBy("template", "need", "doc_id").agg(F.max("own").alias("own"), F.min("h").alias("h"), F.count(F.lit(1)).alias("n"))
    recurring = per_doc.groupBy("template", "need").agg(
        (F.count_if(F.col("own") & F.col("doc_id").isNotNull())
         + F.max(F.when(~F.col("own") & F.col("doc_id").isNotNull(), 1).otherwise(0))).alias("docs"),
        F.min_by("h", "doc_id").alias("first"), F.sum("n").alias("seen"))
    recurring = written(recurring.filter("docs >= need").select("template", "first", "seen"), "recurring")
    found = _joined(known.select("doc_id", "h", "nth", "template"), recurring, ["template"], "inner", hot)
    return found.filter("h <> first").select("doc_id", "h", "nth").distinct()


def without_recurring_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with the recurring lines taken out of ``text``, and n_lines and n_dropped.

    Documents are told apart by ``id_col``. A row without an id counts for no template but loses recurring lines like
    any other. A null text stays null and has 0 lines; an empty one has 1. Blank lines are never dropped, lines of few
    tokens only where they are equal in ``least_docs`` documents, and repeated lines of one document alone recur nowhere.
    Rows with the text in which a template stays keep it, copies included. Rows that repeat lose the same lines each. All other columns
    pass through; those named n_lines or n_dropped are replaced. An empty table gives an empty result.
    """
    docs = docs.drop("n_lines", "n_dropped")
    slim = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(F.col(f"`{text}`")).alias("h"),
                       F.col(f"`{text}`").alias("text"))
    drops = recurring_lines(slim, **options).groupBy("doc_id", "h").agg(F.collect_set("nth").alias("_drop"))
    drops = drops.select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), "_drop")
    body = F.col(f"`{text}`")
    out = docs.join(drops, F.col(f"`{id_col}`").eqNullSafe(F.col("_id")) & (F.xxhash64(body) == F.col("_h")), "left")
    parts = F.split(body, "\n")
    kept = F.concat_ws("\n", F.filter(parts, lambda line, i: ~F.array_contains(F.col("_drop"), i)))
    new = F.when(F.col("_drop").isNull(), body).otherwise(kept)
    return out.select(*[new.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns],
                      F.coalesce(F.array_size(parts), F.lit(0)).alias("n_lines"),
                      F.coalesce(F.array_size("_drop"), F.lit(0)).alias("n_dropped"))


#: The same for the registered query, in DuckDB's SQL.
SQL = f"""
WITH body AS (SELECT doc_id, md5(text) AS h, string_split(text, chr(10)) AS lines FROM documents),
line AS (
 SELECT doc_id, h, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS nth FROM body),
cut AS (
 SELECT doc_id, h, nth, line AS raw, list_filter(string_split_regex(regexp_replace(line, '{VARIABLE}', '<*>', 'g'), '{SPACE}'),
  lambda t: t <> '') AS words FROM line),
deep AS MATERIALIZED (
 SELECT row_number() OVER () AS line, doc_id, h, nth, len(words) AS n,
  CASE WHEN len(words) < {LEAST_TOKENS} THEN array_to_string(words, ' ') ELSE 'line ' || trim(raw, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) END AS equal,
  array_to_string(words[1:{DEPTH}], ' ') AS lead, words[{DEPTH + 1}:] AS rest FROM cut WHERE len(words) > 0),
equal AS (SELECT equal FROM deep GROUP BY equal HAVING count(DISTINCT doc_id) > 1),
own AS (
 SELECT doc_id, h, sum(CASE WHEN e.equal IS NULL THEN 0 ELSE n END) < sum(n) * {COPIED} AS own
 FROM deep d LEFT JOIN equal e ON d.equal = e.equal GROUP BY doc_id, h),
same AS (
 SELECT doc_id, h, nth, 'equal' || chr(10) || d.equal AS template, CASE WHEN n < {LEAST_TOKENS} THEN {LEAST_DOCS} ELSE {LEAST_EQUAL} END AS need
 FROM deep d JOIN equal e ON d.equal = e.equal),
leaf AS (SELECT n, lead FROM deep WHERE n >= {LEAST_TOKENS} GROUP BY n, lead HAVING count(DISTINCT doc_id) >= {LEAST_DOCS}),
cand AS (SELECT d.* FROM deep d JOIN leaf l ON d.n = l.n AND d.lead = l.lead),
part AS (
 SELECT line, n, lead, i, rest[cast(floor(i * len(rest) / {SEGMENTS}) AS int) + 1 : cast(floor((i + 1) * len(rest) / {SEGMENTS}) AS int)] AS seg
 FROM cand, range({SEGMENTS}) r(i)),
fixed AS (SELECT n, lead, i, seg FROM part WHERE len(seg) > 0 GROUP BY ALL HAVING count(*) >= {LEAST_DOCS}),
held AS (
 SELECT p.line, sum(len(p.seg)) AS held, string_agg(cast(p.i AS varchar) || ':' || array_to_string(p.seg, ' '), chr(10) ORDER BY p.i) AS parts
 FROM part p JOIN fixed f ON p.n = f.n AND p.lead = f.lead AND p.i = f.i AND p.seg = f.seg GROUP BY p.line),
mostly AS (
 SELECT c.doc_id, c.h, c.nth, c.n || chr(10) || c.lead || chr(10) || coalesce(h.parts, '') AS template, {LEAST_DOCS} AS need
 FROM cand c LEFT JOIN held h ON c.line = h.line WHERE c.n * {FIXED_SHARE} <= coalesce(h.held, 0) + {DEPTH}),
known AS MATERIALIZED (
 SELECT k.*, own FROM (SELECT * FROM same UNION ALL SELECT * FROM mostly) k JOIN own o ON k.doc_id IS NOT DISTINCT FROM o.doc_id AND k.h = o.h),
recurring AS (
 SELECT template, need, arg_min(h, doc_id) AS first FROM known GROUP BY template, need
 HAVING count(DISTINCT doc_id) FILTER (own) + max(CASE WHEN NOT own AND doc_id IS NOT NULL THEN 1 ELSE 0 END) >= need),
gone AS (
 SELECT doc_id, h, list(DISTINCT nth) AS drop FROM known k JOIN recurring r ON k.template = r.template AND k.need = r.need
 WHERE h <> first GROUP BY doc_id, h),
text AS (
 SELECT d.doc_id, string_split(d.text, chr(10)) AS lines, g.drop FROM documents d
 LEFT JOIN gone g ON d.doc_id IS NOT DISTINCT FROM g.doc_id AND md5(d.text) = g.h),
kept AS (
 SELECT doc_id, len(lines) AS n_lines, coalesce(len(drop), 0) AS n_dropped, CASE WHEN drop IS NULL THEN lines ELSE
  list_filter(lines, lambda x, i: NOT list_contains(drop, i - 1)) END AS lines FROM text)
SELECT doc_id, cast(n_lines AS int) AS n_lines, cast(n_dropped AS int) AS n_dropped,
 sha256(array_to_string(lines, chr(10))) AS kept_sha256 FROM kept"""
