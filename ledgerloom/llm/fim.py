"""Fill-in-the-middle: texts cut at two unit boundaries and put in another order.

A grammar names pairs of neighbouring character classes between which a unit ends. It is
translated to one zero-width regular expression, a lookbehind and a lookahead per pair, at
which `split` cuts: the pieces, put together again, are the text. (A lookbehind of one
class never holds between the halves of a character beyond the basic plane.) Everything is
an expression of the row itself: no shuffle, no Python.

Cuts, form and order come from the hash of a seed and the doc_id, so a document gets the
same answer in every run and beside any other rows.

Defined results: a null text counts as empty; an empty text has no units and is plain; a null
doc_id hashes as if it were empty; texts that hold a marker are plain; repeated rows give
equal rows; an empty table gives an empty result; other columns are ignored, whatever
they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import table

ANY = r"[\s\S]"
#: For each grammar the pairs of classes (before, after) between which a unit ends.
GRAMMARS = {
    "tokens": [("[^A-Za-z]", ANY), ("[A-Za-z]", "[^A-Za-z]")],
    "characters": [(ANY, ANY)],
    "words": [(r"[^\x20\x09-\x0D]", r"[\x20\x09-\x0D]")],
    "lines": [(r"\n", ANY)],
}
MARKS = {"prefix": "<P>", "suffix": "<S>", "middle": "<M>"}
ANY_MARK = "<[PSM]>"
PLAIN_FROM, SPM_BELOW, SEED = 90, 20, 1


def boundary(grammar: str) -> str:
    """The zero-width expression that matches between two units."""
    return "|".join(f"(?<={before})(?={after})" for before, after in GRAMMARS[grammar])


def units(text: Column, grammar: str = "tokens") -> Column:
    """The pieces of a text in their order; none of an empty text."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, boundary(grammar), -1))


def draws(doc_id: Column, seed: int = SEED) -> list[Column]:
    """Four unsigned 32-bit numbers of a document."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def restored(output: Column, form: Column) -> Column:
    """The text that an output of that form came from."""
    part = F.split(output, ANY_MARK, -1)  # before the first mark there is nothing
    return F.when(form == "psm", F.concat(part[1], part[3], part[2])).when(form == "spm", F.concat(part[2], part[3], part[1])).otherwise(output)


def fill_in_middle(docs: DataFrame, grammar: str = "tokens", seed: int = SEED, plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW) -> DataFrame:
    """(doc_id, n, form, prefix, middle, suffix, output) per row; the three parts are null if the form is plain."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    h1, h2, h3, h4 = draws(F.col("doc_id"), seed)
    cut = docs.select("doc_id", text.alias("text"), units(text, grammar).alias("u"), F.array(h1, h2, h3, h4).alias("h"))
    n = F.size("u").cast("long")
    cut = cut.select("doc_id", "text", "u", n.alias("n"), "h", *(F.pmod(F.col("h")[i], n + 1).alias(c) for i, c in enumerate("xy")))
    cut = cut.withColumns({"a": F.least("x", "y").cast("int"), "b": F.greatest("x", "y").cast("int")})
    plain = (F.col("text") == "") | F.col("text").rlike(ANY_MARK) | (F.pmod(F.col("h")[2], F.lit(100)) >= plain_from)
    form = F.when(plain, "plain").when(F.pmod(F.col("h")[3], F.lit(100)) < spm_below, "spm").otherwise("psm")
    part = lambda start, size: F.when(F.col("form") != "plain", F.array_join(F.slice("u", start, size), ""))
    a, b = F.col("a"), F.col("b")
    parts = cut.withColumn("form", form).select("doc_id", "n", "form", "text", part(F.lit(1), a).alias("prefix"), part(a + 1, b - a).alias("middle"), part(b + 1, F.size("u") - b).alias("suffix"))
    put = lambda *names: F.concat(*(x for c in names for x in (F.lit(MARKS[c]), F.col(c))))
    output = F.when(F.col("form") == "psm", put("prefix", "suffix", "middle")).when(F.col("form") == "spm", put("suffix", "prefix", "middle")).otherwise(F.col("text"))
    return parts.select("doc_id", "n", "form", "prefix", "middle", "suffix", output.alias("output"))


def op11_lookaround_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fill_in_middle(table(spark, sf_dir, "documents"))
    size = lambda c: F.char_length(c).cast("long").alias(f"{c}_chars")
    return done.select("doc_id", "n", "form", size("prefix"), size("middle"), F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


SQL_OP11 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || doc_id) AS x FROM documents),
u AS (
  SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS u,
    ('0x' || x[1:8])::BIGINT AS h1, ('0x' || x[9:16])::BIGINT AS h2, ('0x' || x[17:24])::BIGINT AS h3, ('0x' || x[25:32])::BIGINT AS h4
  FROM d),
c AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b FROM u),
p AS (
  SELECT doc_id, t, n::BIGINT AS n, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:n], '') AS s,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE t END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""
