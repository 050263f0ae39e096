"""Line dedup with a log-template tree, in DataFrame operations only.

A line's tokens go down a tree of fixed depth: the token count, then the leading tokens, with tokens that hold a digit
read as the variable <*>. Lines equal after that masking are one exact template. In a leaf, exact templates are also
cut into fields by position, a token each in shorter lines and FIELDS runs of tokens in longer ones. A field is
constant if two templates of the leaf have it, in two documents or more, and variable otherwise; templates with the
same constant fields, LEAST_CONSTANT of FIELDS of them at least, are one.
A template that recurs across documents is dropped, but for its first line (by doc_id, then line), so that no text
vanishes from the corpus: exact copies of a document keep one copy of each line among them. With ``keep_first=False``
the first line goes too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import join_skewed, row_key
from strandloom.llm.registry_base import register
from strandloom.session import table, written

#: Lines of fewer tokens are left alone: so short, they recur by chance. LEAD is the depth of the tree below the count.
MIN_TOKENS, LEAD = 4, 3
#: Lines of fewer tokens than FIELD_TOKENS have a field per token, others FIELDS runs of tokens.
FIELD_TOKENS, FIELDS, LEAST_CONSTANT = 16, 8, 6
#: A token with a digit. It can only start where a token does, and does not backtrack, so long tokens stay linear.
VARIABLE = r"(?<![^\x20\x09-\x0D])[^0-9\x20\x09-\x0D]*+[0-9][^\x20\x09-\x0D]*+"
BLANKS = r"[\x20\x09-\x0D]+"


def key_columns(name: str) -> list[Column]:
    """The two halves of a row's key by doc_id and text."""
    key = row_key("doc_id", "text")
    return [key["a"].alias(f"{name}a"), key["b"].alias(f"{name}b")]


def parsed(docs: DataFrame) -> DataFrame:
    """(ra, rb, doc_id, line, leaf, ta, tb, fields) of every line with enough tokens; only hashes leave the text.

    ra and rb say which document: repeated rows are one, two texts under one id are two. ta and tb are the exact
    template. Each have 128 bits, in plain columns, which sort and hash without objects. Lines
    are cut into tokens inside the generator: its output is computed once, where a filter on a column computed after
    it would be pushed down and compute it again.
    """
    masked = lambda s: F.when(s.rlike("[0-9]"), F.regexp_replace(s, VARIABLE, "<*>")).otherwise(s)
    tokens = F.transform(F.split("text", "\n"), lambda s: F.split(F.btrim(masked(s), F.lit(" \t\n\x0b\x0c\r")), BLANKS))
    lines = docs.where("text IS NOT NULL").select(*key_columns("r"), "doc_id", F.posexplode(tokens).alias("line", "t")).where(F.size("t") >= MIN_TOKENS)
    n = F.size("t")
    size = F.when(n < FIELD_TOKENS, n).otherwise(FIELDS)
    start = lambda k: F.floor(k * n / size).cast("int")
    fields = F.transform(F.sequence(F.lit(0), size - 1), lambda k: F.xxhash64(F.slice("t", start(k) + 1, start(k + 1) - start(k))))
    return lines.select("ra", "rb", "doc_id", "line", F.xxhash64(n, F.slice("t", 1, LEAD)).alias("leaf"), F.xxhash64("t").alias("ta"), F.xxhash64(F.lit(1), "t").alias("tb"), fields.alias("fields"))


def dropped_lines(docs: DataFrame, keep_first: bool = True) -> DataFrame:
    """(ra, rb, line): the lines to drop.

    Fields are compared among exact templates, a row each however often they occur, so what generalises depends on
    which values there are and not on how many documents have each. Keys that many rows share (a template, a field or
    a generalised template) are combined before each shuffle and joined back by ``join_skewed``.
    """
    lines = written(parsed(docs), "lines")
    first = F.min(F.struct("doc_id", "ra", "rb", "line")).alias("first")
    in_two = [F.min("a").alias("a"), F.max("b").alias("b")]
    templates = lines.groupBy("ta", "tb").agg(first, F.min("ra").alias("a"), F.max("ra").alias("b"), F.count("*").alias("n"), F.any_value("leaf").alias("leaf"), F.any_value("fields").alias("fields"))
    templates = written(templates, "templates")
    leaves = written(templates.groupBy("leaf").agg(F.count("*").alias("_n"), *in_two).where("_n > 1 AND a <> b").select("leaf", "_n"), "leaves")
    crowded = written(join_skewed(templates.select("ta", "tb", "leaf", "a", "b", "fields"), leaves, ["leaf"]), "crowded")
    cells = crowded.select("ta", "tb", "leaf", "a", "b", F.size("fields").alias("size"), F.posexplode("fields").alias("k", "h"))
    constant = written(cells.groupBy("leaf", "k", "h").agg(F.count("*").alias("_n"), *in_two).where("_n > 1 AND a <> b").select("leaf", "k", "h", "_n"), "constant")
    kept = join_skewed(cells.drop("a", "b"), constant, ["leaf", "k", "h"])
    signed = kept.groupBy("ta", "tb").agg(F.count("*").alias("same"), F.max("size").alias("size"), F.max("leaf").alias("leaf"), F.bit_xor(F.xxhash64("k", "h")).alias("sa"), F.bit_xor(F.xxhash64(F.lit(1), "k", "h")).alias("sb")).where(F.col("same") * FIELDS >= F.col("size") * LEAST_CONSTANT)
    general = written(templates.select("ta", "tb", "first", "a", "b").join(signed.select("ta", "tb", "leaf", "sa", "sb"), ["ta", "tb"]), "general")
    groups = written(general.groupBy("leaf", "sa", "sb").agg(F.min("first").alias("head"), F.count("*").alias("_n"), *in_two).where("_n > 1 AND a <> b").drop("a", "b"), "groups")
    grouped = join_skewed(general.select("ta", "tb", "leaf", "sa", "sb"), groups, ["leaf", "sa", "sb"]).select("ta", "tb", "head")
    heads = templates.select("ta", "tb", "first", "a", "b", "n").join(grouped, ["ta", "tb"], "left").where("head IS NOT NULL OR a <> b")
    head = F.coalesce("head", "first")
    heads = written(heads.select("ta", "tb", head["ra"].alias("fa"), head["rb"].alias("fb"), head["line"].alias("fl"), F.col("n").alias("_n")), "heads")
    met = join_skewed(lines.select("ra", "rb", "line", "ta", "tb"), heads, ["ta", "tb"])
    return (met.where("ra <> fa OR rb <> fb OR line <> fl") if keep_first else met).select("ra", "rb", "line")


def deduplicated(docs: DataFrame, keep_first: bool = True) -> DataFrame:
    """``docs`` with the lines of recurring templates gone from ``text``, and n_lines_, n_dropped_ beside its columns.

    Lines are what \\n separates; kept ones are joined by \\n again. Null texts stay null with no lines, empty ones have
    one line. Rows with the same id and text are one document, so repeats alone do not make a template recur; null ids
    are told apart by their texts. Ties between equal lines go to the smaller doc_id, null before all. An empty table
    gives an empty result. Columns of any name may be there; only n_lines_ and n_dropped_ would come twice.
    """
    gone = dropped_lines(docs, keep_first).groupBy("ra", "rb").agg(F.collect_set("line").alias("gone"))
    boxed = docs.select(*key_columns("r"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    # most texts lose nothing and are not cut again
    cut = boxed.join(gone, ["ra", "rb"], "left").withColumn("parts", F.when(F.col("gone").isNotNull(), F.split("row.text", "\n")))
    left = F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), F.col("gone")), lambda i: F.get("parts", i)), "\n")
    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(left)
    n_lines = F.coalesce(F.length("row.text") - F.length(F.replace("row.text", F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long")
    return cut.select(*[(text if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns], n_lines.alias("n_lines_"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped_"))


LINES_SQL = f"""
WITH l AS (SELECT doc_id, unnest(range(0, len(p))) AS line, unnest(p) AS s FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)),
t AS (SELECT doc_id, line, list_transform(regexp_extract_all(s, '[^\\x20\\x09-\\x0D]+'), lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS t FROM l),
m AS (SELECT doc_id, line, t, len(t) AS n, len(t) || ' ' || array_to_string(t[1:{LEAD}], ' ') AS leaf, array_to_string(t, ' ') AS tmpl FROM t WHERE len(t) >= {MIN_TOKENS}),
e AS (SELECT tmpl, any_value(leaf) AS leaf, any_value(n) AS n, any_value(t) AS t, min(doc_id) AS a, max(doc_id) AS b, CASE WHEN any_value(n) < {FIELD_TOKENS} THEN any_value(n) ELSE {FIELDS} END AS z FROM m GROUP BY tmpl),
c AS (SELECT *, unnest(range(0, z)) AS k FROM e),
f AS (SELECT tmpl, leaf, a, b, z, k, array_to_string(t[k * n // z + 1:(k + 1) * n // z], ' ') AS h FROM c),
o AS (SELECT leaf, k, h FROM f GROUP BY leaf, k, h HAVING count(*) > 1 AND min(a) <> max(b)),
g AS (SELECT tmpl, leaf AS gl, string_agg(k || ':' || h, '|' ORDER BY k) AS sig FROM f JOIN o USING (leaf, k, h) GROUP BY tmpl, leaf, z HAVING count(*) * {FIELDS} >= z * {LEAST_CONSTANT}),
u AS (SELECT doc_id, line, gl, sig, CASE WHEN sig IS NULL THEN tmpl END AS own FROM m LEFT JOIN g USING (tmpl)),
d AS (SELECT doc_id, line FROM (SELECT *, row_number() OVER (PARTITION BY gl, sig, own ORDER BY doc_id, line) AS k, min(doc_id) OVER (PARTITION BY gl, sig, own) AS a, max(doc_id) OVER (PARTITION BY gl, sig, own) AS b FROM u) WHERE k > 1 AND a <> b),
k AS (SELECT l.doc_id, string_agg(s, chr(10) ORDER BY line) AS text FROM l ANTI JOIN d ON l.doc_id = d.doc_id AND l.line = d.line GROUP BY l.doc_id),
n AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id)
SELECT w.doc_id, len(string_split(w.text, chr(10)))::BIGINT AS n_lines, coalesce(n.n, 0)::BIGINT AS n_dropped, sha256(coalesce(k.text, '')) AS kept_sha256
FROM documents w LEFT JOIN k USING (doc_id) LEFT JOIN n USING (doc_id)"""


def counted(out: DataFrame) -> DataFrame:
    return out.select("doc_id", F.col("n_lines_").alias("n_lines"), F.col("n_dropped_").alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@register("op2_line_templates_whole", LINES_SQL)
@register("op2_line_templates", LINES_SQL)
def op2_line_templates(spark, sf_dir):
    return counted(deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text")))
