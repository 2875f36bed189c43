"""Fill-in-middle transformation (operator 13): texts cut in three at units of a word with the white space before it, by DataFrame functions only.

A hash of the seed and the id decides whether a text stays plain, between which units it is cut, and the order of its parts. The offsets of the cuts
are found relationally: the lengths of a text's units are exploded with their ordinals, a window sums them up, the cut requests of a
document meet its units by ordinal, and the offsets met are aggregated to one row a document, which cuts the text by substring.

Only documents that are cut are numbered, dealt by their number and written to the shared folder as a bucketed table, so that their numbers hold whatever is computed again, and
neither the window nor the joins, all on that number, move a row: a unit stays where its text is. No two rows share a number: no key is hot. A document's window
holds its own units, up to its later cut.

Results that the cases have: null and empty texts are plain, with 0 units; a null id hashes as the empty string; rows that repeat are each cut,
alike; other columns stay where `keep` names them; a text that holds a marker is plain; an empty table gives an empty result; texts are cut whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bucketed, col, text_of

# The units, the markers of prefix, suffix and middle, the seed and the shares in percent.
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, CUT_SHARE, SPM_SHARE = 42, 50, 80


def drawn(id_text: Column, nth: int, seed: int) -> Column:
    """The n-th group of 8 hexadecimal digits of the hash of seed and id, from 1, as a number."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), id_text), 256), 8 * nth - 7, 8), 16, 10).cast("long")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. The markers stand in it once each, as no part holds one."""
    def parts(first: str, second: str, third: str) -> tuple[Column, Column, Column]:
        rest = F.substr(output, F.lit(len(first) + 1))
        one = F.substring_index(rest, second, 1)
        rest = F.substr(rest, F.length(one) + len(second) + 1)
        two = F.substring_index(rest, third, 1)
        return one, two, F.substr(rest, F.length(two) + len(third) + 1)

    prefix, suffix, middle = parts(PREFIX, SUFFIX, MIDDLE)
    suffix2, prefix2, middle2 = parts(SUFFIX, PREFIX, MIDDLE)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix2, middle2, suffix2)).otherwise(output)


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, cut_share: int = CUT_SHARE, spm_share: int = SPM_SHARE, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row a document: (id_col, *keep, n units, form plain, psm or spm, prefix_chars, middle_chars, output)."""
    name = F.coalesce(col(id_col).cast("string"), F.lit(""))
    rows = docs.select(F.struct(col(id_col).alias("id"), *(col(c).alias(f"c{k}") for k, c in enumerate(keep))).alias("doc"), name.alias("name"), text_of(docs, text_col).alias("text"))
    marked = F.col("text").contains(PREFIX) | F.col("text").contains(SUFFIX) | F.col("text").contains(MIDDLE)
    form = F.when((F.col("text") == "") | marked | (drawn(F.col("name"), 3, seed) % 100 >= cut_share), "plain").when(drawn(F.col("name"), 4, seed) % 100 < spm_share, "spm").otherwise("psm")
    rows = rows.withColumn("form", form)
    plain = rows.where("form = 'plain'").select(
        "doc", F.regexp_count("text", F.lit(UNIT)).cast("long").alias("n"), "form", F.lit(None).cast("long").alias("prefix_chars"), F.lit(None).cast("long").alias("middle_chars"), F.col("text").alias("output")
    )
    count = F.regexp_count("text", F.lit(UNIT)).cast("long")
    ends = [drawn(F.col("name"), nth, seed) % (F.col("n") + 1) for nth in (1, 2)]
    cut = rows.where("form <> 'plain'").select(F.monotonically_increasing_id().alias("row"), "doc", "name", "text", "form", count.alias("n"))
    # the request of a document: the ordinals of the units that end its prefix and its middle, 0 where nothing comes before
    cut = bucketed(cut.select("row", "doc", "text", "form", "n", F.least(*ends).cast("int").alias("first"), F.greatest(*ends).cast("int").alias("second")), "row", "cut")
    lengths = F.transform(F.regexp_extract_all("text", F.lit(UNIT), F.lit(0)), lambda u: F.length(u))
    units = cut.select("row", F.posexplode(F.slice(lengths, F.lit(1), F.col("second"))).alias("ordinal", "length"))
    summed = units.select("row", (F.col("ordinal") + 1).alias("ordinal"), F.sum("length").over(Window.partitionBy("row").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)).alias("until"))
    requests = cut.select(F.col("row").alias("asked"), "first", "second")
    met = requests.hint("merge").join(summed, (F.col("row") == F.col("asked")) & ((F.col("ordinal") == F.col("first")) | (F.col("ordinal") == F.col("second"))), "left")
    offsets = met.groupBy("asked").agg(
        F.coalesce(F.max(F.when(F.col("ordinal") == F.col("first"), F.col("until"))), F.lit(0)).alias("a"), F.coalesce(F.max(F.when(F.col("ordinal") == F.col("second"), F.col("until"))), F.lit(0)).alias("b")
    )
    part = {
        PREFIX: F.substr("text", F.lit(1), F.col("a").cast("int")), MIDDLE: F.substr("text", F.col("a").cast("int") + 1, (F.col("b") - F.col("a")).cast("int")), SUFFIX: F.substr("text", F.col("b").cast("int") + 1)
    }

    def joined(*order: str) -> Column:
        return F.concat(*(x for m in order for x in (F.lit(m), part[m])))

    done = cut.hint("merge").join(offsets, F.col("row") == F.col("asked")).select(
        "doc", "n", "form", F.col("a").alias("prefix_chars"), (F.col("b") - F.col("a")).alias("middle_chars"), F.when(F.col("form") == "psm", joined(PREFIX, SUFFIX, MIDDLE)).otherwise(joined(SUFFIX, PREFIX, MIDDLE)).alias("output")
    )
    return plain.union(done).select(F.col("doc.id").alias(id_col), *(F.col(f"doc.c{k}").alias(c) for k, c in enumerate(keep)), "n", "form", "prefix_chars", "middle_chars", "output")


def op13_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    out = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256")
    )


OP13_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256(concat('42:', CAST(doc_id AS VARCHAR))) AS h,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM documents),
d AS (SELECT doc_id, text, u, len(u) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(u) + 1) AS x, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(u) + 1) AS y,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 50 THEN 'plain'
      WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM t),
p AS (SELECT doc_id, text, n, form, array_to_string(u[1:least(x, y)], '') AS a, array_to_string(u[least(x, y) + 1:greatest(x, y)], '') AS b, array_to_string(u[greatest(x, y) + 1:], '') AS c FROM d)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(a) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(b) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN concat('<P>', a, '<S>', c, '<M>', b) ELSE concat('<S>', c, '<P>', a, '<M>', b) END) AS output_sha256, sha256(text) AS restored_sha256
FROM p
"""
