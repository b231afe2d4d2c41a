"""Line dedup by a deletion-neighbourhood join: of equal or nearly equal lines the earliest stays.

Lines are compared as words (A-Z in lower case, white space collapsed); an edit is one word put in, left
out or exchanged. Lines of ``min_words`` words or more are dropped if an equal line came earlier. Lines of
``edit_words`` or more are dropped too if an earlier line is one edit away. Shorter lines always stay.
Earlier means: smaller doc_id (null first), then row order, then line number; "earlier line" counts also
where it is dropped itself.

Near lines: every distinct line emits the hash of itself and of each variant without one word. Two lines
that are one exchange apart share a variant at the same place; a line and a longer one share the whole and
a variant. A line meets the earliest line of each key it has, and each such pair is verified by comparing the
two variants' words (lost is only a pair whose key is shared by an earlier, unlike line, by chance of 64 bits).
Two cheap keys of half a line come first: an edit leaves the first or the last half of the words whole, so
lines that share neither half with another line cannot have a partner and emit no variants. Nothing is capped.

A group of equal lines is one row after partial aggregation. The earliest of the lines that share a variant
is found by partial aggregation too, and met by a join that adaptive execution can split; no pairs within
a group are made. The plan is the same at every size.

Null texts stay null, empty texts and lines without a word stay. A text whose every line is dropped becomes
empty. Rows of one doc_id are told apart by a number that is written down with the rows once. Further columns
are left alone; one called like the output is kept under its name and ``_input``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from convarchive.llm.common import ascii_lower, let, numbered, put_back, require, set_aside, stored, table

MIN_WORDS = 3
EDIT_WORDS = 10
OUTPUT, INNER = ("n_dropped_lines",), ("__row", "__gone")
SPACES, NO_SPACES = "\t\n\x0b\x0c\r", "     "


def normal(line: Column) -> Column:
    """The line's words with one space between them, A-Z in lower case; each step is skipped where it changes nothing."""
    flat = F.trim(F.when(line.rlike(r"[\x09-\x0D]"), F.translate(line, SPACES, NO_SPACES)).otherwise(line))
    single = F.when(F.contains(flat, F.lit("  ")), F.regexp_replace(flat, " +", " ")).otherwise(flat)
    plain = (F.length(single) == F.octet_length(single)) | ~single.rlike(r"[\p{IsUppercase}\p{Lt}&&[^A-Z]]")
    return F.when(plain, F.lower(single)).otherwise(ascii_lower(single))


def n_words(said: Column) -> Column:
    """Of a line in normal form."""
    return F.when(said == "", 0).otherwise(F.length(said) - F.length(F.replace(said, F.lit(" "))) + 1)


def _words_from(said: Column, n: Column) -> Column:
    """The first ``n`` words, or the last ``-n``."""
    return F.call_function("substring_index", said, F.lit(" "), n.cast("int"))


def halves(said: Column, n: Column) -> Column:
    """Hashes of the first and last words, as many as an edit to a line of equal or one more length must spare on one side."""

    def at(h: Column) -> Column:
        first = F.xxhash64(F.lit("first"), _words_from(said, h))
        last = F.xxhash64(F.lit("last"), _words_from(said, -h))
        return F.array(first, last)

    half = F.floor(n / 2).cast("int")
    return F.when(n % 2 == 1, at(half)).otherwise(F.concat(at(half - 1), at(half)))


def line_rows(rows: DataFrame, edit_words: int) -> DataFrame:
    """``(row, doc_id, line, id, n, keys)`` of all lines; ``keys`` where edits count."""
    out = rows.select(F.col("__row").alias("row"), "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "said"))
    out = out.withColumn("said", normal(F.col("said"))).withColumn("n", n_words(F.col("said")))
    return out.select(
        "row", "doc_id", "line", F.unhex(F.md5("said")).alias("id"), "n", F.when(F.col("n") >= edit_words, halves(F.col("said"), F.col("n"))).alias("keys")
    )


def place() -> Column:
    return F.struct("doc_id", "row", "line")


def variants(lines: DataFrame) -> DataFrame:
    """``(doc_id, row, line, n, at, key)``: each line's whole (at 0) and its variant without word ``at``, from ``(doc_id, row, line, said, n)``.

    A variant's key is the exclusive or of a hash of each word and its place. Leaving out the next word
    instead of this one changes two terms, so all variants follow from the first by a running xor.
    """
    w = F.col("w")

    def term(i: Column, j: Column) -> Column:
        return F.xxhash64(F.get(w, i), j)

    n = F.size(w)
    whole = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0).cast("long"), lambda a, i: a.bitwiseXOR(term(i, i)))
    first = F.aggregate(F.sequence(F.lit(1), n - 1), F.lit(0).cast("long"), lambda a, i: a.bitwiseXOR(term(i, i - 1)))
    steps = F.transform(F.sequence(F.lit(0), n - 2), lambda i: term(i, i).bitwiseXOR(term(i + 1, i)))
    block = F.lit(512)
    # the running xor in blocks, so that appending costs no more than a block each time
    spans = F.sequence(F.lit(0), F.floor((n - 2) / block).cast("int"))

    def along(steps: Column, start: Column) -> Column:
        zero = F.struct(start.alias("now"), F.array().cast("array<bigint>").alias("all"))
        return F.aggregate(
            steps, zero, lambda a, s: F.struct(a["now"].bitwiseXOR(s).alias("now"), F.concat(a["all"], F.array(a["now"].bitwiseXOR(s))).alias("all"))
        )

    def run(s: Column) -> Column:
        ran = F.aggregate(
            spans,
            F.struct(first.alias("now"), F.array(F.array(first)).alias("all")),
            lambda a, k: let(
                along(F.slice(s, k * block + 1, block), a["now"]),
                lambda part: F.struct(part["now"].alias("now"), F.concat(a["all"], F.array(part["all"])).alias("all")),
            ),
            lambda a: a["all"],
        )
        return F.flatten(ran)

    keys = F.concat(F.array(whole), let(steps, run))
    return lines.withColumn("w", F.split("said", " ")).select("doc_id", "row", "line", "n", F.posexplode(keys).alias("at", "key"))


def without(said: Column, n: Column, at: Column) -> Column:
    """The line without word ``at`` (from 1; 0: all of it)."""
    front, behind = _words_from(said, at - 1), _words_from(said, at - n)
    return F.when(at == 0, said).otherwise(F.concat_ws(" ", F.nullif(front, F.lit("")), F.nullif(behind, F.lit(""))))


def likely_lines(rows: DataFrame, firsts: DataFrame) -> DataFrame:
    """``(id, doc_id, row, line, said, n)`` of the distinct lines that share a half with another, from ``firsts(id, row, line, keys)``."""
    halved = firsts.where("keys is not null").select("row", "line", "id", F.explode("keys").alias("half"))
    shared = halved.groupBy("half").agg(F.count("*").alias("c")).where("c > 1").select("half")
    likely = halved.join(shared, "half", "left_semi").groupBy("row", "line").agg(F.first("id").alias("id"))
    wanted = likely.groupBy("row").agg(F.collect_list(F.struct("line", "id")).alias("wanted"))
    met = rows.select(F.col("__row").alias("row"), "doc_id", "text").join(wanted, "row")
    found = let(F.split("text", "\n", -1), lambda x: F.transform("wanted", lambda y: F.struct(y["line"].alias("line"), y["id"].alias("id"), F.get(x, y["line"]).alias("said"))))
    out = met.select("row", "doc_id", F.explode(found).alias("x")).select("x.id", "doc_id", "row", "x.line", normal(F.col("x.said")).alias("said"))
    return out.withColumn("n", n_words(F.col("said")))


def near_lines(lines: DataFrame) -> DataFrame:
    """``(row, line)`` of those ``lines`` that have an earlier one at one edit."""
    out = variants(lines).withColumn("m", F.col("n") - (F.col("at") > 0).cast("int"))
    # the earliest line of each variant at its place, then of each variant as a whole line and as what another leaves
    same = out.groupBy("key", "m", "at").agg(F.min(place()).alias("same"), F.count("*").alias("c"))
    rest = F.when(F.col("at") > 0, F.struct("same", "at"))
    met = same.groupBy("key", "m").agg(F.min(F.when(F.col("at") == 0, F.col("same"))).alias("whole"), F.min(rest).alias("rest"), F.sum("c").alias("c"))
    out = out.join(met.where("c > 1").drop("c"), ["key", "m"]).join(same.where("c > 1").select("key", "m", "at", "same"), ["key", "m", "at"], "left")

    def partner(first: Column, at: Column) -> Column:
        return F.when(first < place(), F.struct(first.alias("first"), at.cast("int").alias("at")))

    # exchanged: the same rest at the same place; put in or left out: the whole of one line is the rest of another
    partners = F.when(F.col("at") > 0, F.array(partner(F.col("same"), F.col("at")), partner(F.col("whole"), F.lit(0)))).otherwise(
        F.array(partner(F.col("rest.same"), F.col("rest.at")))
    )
    pairs = out.select("row", "line", "at", F.explode(F.array_compact(partners)).alias("q"))
    pairs = pairs.select("row", "line", "at", F.col("q.first.row").alias("first_row"), F.col("q.first.line").alias("first_line"), F.col("q.at").alias("first_at"))
    one = lines.select("row", "line", "said", "n")
    two = lines.select(F.col("row").alias("first_row"), F.col("line").alias("first_line"), F.col("said").alias("first_said"), F.col("n").alias("first_n"))
    met = pairs.join(one, ["row", "line"]).join(two, ["first_row", "first_line"])
    alike = without(F.col("said"), F.col("n"), F.col("at")) == without(F.col("first_said"), F.col("first_n"), F.col("first_at"))
    return met.where(alike).select("row", "line").distinct()


def dropped_lines(rows: DataFrame, min_words: int = MIN_WORDS, edit_words: int = EDIT_WORDS) -> DataFrame:
    """``(row, line)`` of all lines to drop, of documents with ``__row``."""
    lines = stored(line_rows(rows, edit_words)).where(F.col("n") >= min_words)
    firsts = lines.groupBy("id").agg(F.min(place()).alias("pos"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    firsts = stored(firsts.withColumns({"row": F.col("pos.row"), "line": F.col("pos.line")}))
    likely = stored(likely_lines(rows, firsts))
    near = likely.join(near_lines(likely), ["row", "line"], "left_semi").select("id", place().alias("pos"), F.lit(True).alias("near"))
    again = firsts.where("copies > 1").select("id", "pos", F.lit(False).alias("near"))
    judged = stored(near.unionByName(again).groupBy("id").agg(F.first("pos").alias("pos"), F.max("near").alias("near")))
    met = lines.select("row", "doc_id", "line", "id").join(judged, "id")
    return met.where(F.col("near") | (place() != F.col("pos"))).select("row", "line")


def dedup_lines(documents: DataFrame, min_words: int = MIN_WORDS, edit_words: int = EDIT_WORDS) -> DataFrame:
    """``documents`` with ``text`` less its dropped lines, and ``n_dropped_lines``."""
    rows = numbered(set_aside(require(documents, "doc_id", "text"), *OUTPUT, *INNER))
    gone = dropped_lines(rows, min_words, edit_words).groupBy("row").agg(F.sort_array(F.collect_list("line")).alias("__gone"))
    out = rows.join(gone.withColumnRenamed("row", "__row"), "__row", "left")
    lines = F.split("text", "\n", -1)
    # a sorted list of places: those between two dropped lines stay
    cuts = F.concat(F.array(F.lit(-1)), F.col("__gone"), F.array(F.size(lines)))
    stay = let(
        F.struct(lines.alias("l"), cuts.alias("c")),
        lambda x: F.flatten(
            F.transform(F.sequence(F.lit(1), F.size(x["c"]) - 1), lambda k: F.slice(x["l"], F.get(x["c"], k - 1) + 2, F.get(x["c"], k) - F.get(x["c"], k - 1) - 1))
        ),
    )
    text = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.array_join(stay, "\n"))
    out = out.withColumns({"text": text, "n_dropped_lines": F.coalesce(F.size("__gone"), F.lit(0)).cast("long")}).drop(*INNER)
    return put_back(out, documents, (*OUTPUT, *INNER), INNER)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "text", "n_dropped_lines", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text, string_split(text, chr(10)) AS l FROM documents),
x AS (SELECT r, doc_id, unnest(l) AS said, generate_subscripts(l, 1) AS k FROM d),
y AS (SELECT *, list_filter(regexp_split_to_array(translate(said, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda t: t <> '') AS w FROM x),
z AS (SELECT *, len(w) AS n, array_to_string(w, ' ') AS id, row_number() OVER (ORDER BY doc_id NULLS FIRST, r, k) AS pos FROM y WHERE len(w) >= 3),
f AS (SELECT id, min(pos) AS pos, any_value(w) AS w, any_value(n) AS n FROM z GROUP BY id),
v AS (SELECT id, pos, n, i, array_to_string(w[1:i-1] || w[i+1:n], ' ') AS rest FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM f WHERE n >= 10)),
e AS (SELECT rest, i, n, min(pos) AS first FROM v GROUP BY ALL HAVING count(*) > 1),
near AS (
  SELECT v.id FROM v JOIN e USING (rest, i, n) WHERE first < pos
  UNION SELECT CASE WHEN f.pos < v.pos THEN v.id ELSE f.id END FROM v JOIN f ON f.id = v.rest AND f.n = v.n - 1 WHERE f.n >= 10),
gone AS (SELECT z.r, z.k FROM z JOIN f USING (id) WHERE z.pos <> f.pos OR id IN (SELECT id FROM near)),
left_over AS (
  SELECT x.r, coalesce(string_agg(said, chr(10) ORDER BY x.k) FILTER (WHERE gone.r IS NULL), '') AS text, count(gone.r) AS n
  FROM x LEFT JOIN gone ON gone.r = x.r AND gone.k = x.k GROUP BY x.r)
SELECT doc_id, CASE WHEN d.text IS NOT NULL THEN o.text END AS text, coalesce(o.n, 0)::BIGINT AS n_dropped_lines,
  sha256(CASE WHEN d.text IS NULL THEN '' ELSE o.text END) AS text_sha256
FROM d LEFT JOIN left_over o USING (r)
"""
