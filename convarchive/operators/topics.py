"""Term cloud and topics over notes without a project.

``notes(note_id, title, body, project, date, …)``; ``rules(topic, kind, field, value)`` with kind ``word``,
``phrase`` or ``field``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from convarchive.functions.text import fold_accents, found_tokens, strip_space, topic_tokens
from convarchive.sources.shared import new_folder

#: Words that say nothing about a note's subject, without accents. Callers may pass their own.
STOPWORDS = (
    "the and for are with this that from was you your have has not but all can will one more about into over which their there when where what "
    "los las una unos unas del con por para como mas pero sus este esta esto todo todos que les und der die das den dem des von zu mit ist auf fur "
    "des les une dans est pour par sur avec pas plus qui que ses aux user assistant http https www com"
).split()


def orphans(notes: DataFrame) -> DataFrame:
    """Notes whose project is missing, empty or ``none``."""
    return notes.where(F.coalesce(F.lower(strip_space(F.col("project"))), F.lit("none")).isin("none", ""))


def tokens(notes: DataFrame) -> DataFrame:
    """``(note_id, token)``: distinct tokens of title and body."""
    return notes.select("note_id", F.explode(topic_tokens(F.concat_ws("\n", "title", "body"))).alias("token"))


def doc_freq(notes: DataFrame) -> DataFrame:
    """``(token, n)``: how many notes with an id have a token. Its exchange is the same for all who ask, so Spark reuses it."""
    return tokens(notes.where("note_id is not null")).groupBy("token").agg(F.count("*").alias("n"))


def generic_terms(notes: DataFrame, stopwords: list[str] = STOPWORDS, min_df: int = 3, max_ratio: float = 0.25, top: int = 100) -> DataFrame:
    """The ``top`` terms in the band from ``min_df`` notes to ``max(int(total * max_ratio), min_df)``."""
    total = notes.agg(F.greatest(F.floor(F.count("*") * max_ratio), F.lit(min_df)).alias("most"))
    bounded = doc_freq(notes).join(F.broadcast(total), F.col("n").between(min_df, F.col("most")))
    return bounded.where(~F.col("token").isin(stopwords)).select("token", "n").orderBy(F.desc("n"), "token").limit(top)


def project_vocab(sources: list[DataFrame]) -> DataFrame:
    """``(token, project)`` from frames of ``project`` names; an earlier source wins, then the smaller name. A whole name is a term too."""
    ranked = [s.select("project", F.lit(i).alias("source")) for i, s in enumerate(sources)]
    names = reduce(DataFrame.unionByName, ranked).where("project is not null").distinct()
    whole = F.array(fold_accents(strip_space(F.col("project"))))
    terms = names.select("project", "source", F.explode(F.array_distinct(F.concat(topic_tokens(F.col("project")), whole))).alias("token"))
    best = F.min(F.struct("source", "project")).alias("best")
    return terms.groupBy("token").agg(best).select("token", F.col("best.project").alias("project"), F.col("best.source").alias("source"))


def term_cloud(notes: DataFrame, vocab: DataFrame, **band) -> DataFrame:
    """Generic terms, and project terms that occur without being generic; ``project`` marks the latter and any generic one it names."""
    generic = generic_terms(notes, **band)
    named = doc_freq(notes).join(vocab.select("token"), "token", "left_semi").join(generic, "token", "left_anti")
    return generic.unionByName(named).join(vocab.select("token", "project"), "token", "left")


def notes_for_term(notes: DataFrame, term: str, limit: int = 200) -> DataFrame:
    """The newest ``limit`` notes with a term, each with the ``total``."""
    found = tokens(notes).where(F.col("token") == fold_accents(F.lit(term))).select("note_id")
    met = notes.join(found, "note_id", "left_semi").select("note_id", "title", "date")
    total = met.agg(F.count("*").alias("total"))
    return met.orderBy(F.desc_nulls_last("date"), "note_id").limit(limit).crossJoin(F.broadcast(total))


def rule_table(spark: SparkSession, topics: dict[str, list[str]]) -> DataFrame:
    """Rules from a topic map: ``field=value``, a phrase where there is a space, else a word."""
    rows = []
    for topic, rules in topics.items():
        for r in rules:
            field, eq, value = r.partition("=")
            rows.append((topic, "field", field, value) if eq else (topic, "phrase" if " " in r.strip() else "word", None, r))
    return spark.createDataFrame(rows, "topic string, kind string, field string, value string")


#: Characters on each side of a space that phrases and texts meet by, and of the grams of phrases without a space.
SIDE, GRAM = 3, 3
#: Up to so many phrases are looked for in each text directly.
DIRECT = 64


def _pairs(text: Column) -> Column:
    """What stands on both sides of each space: ``array<struct<l, r>>``."""
    pieces = F.split(text, " ", -1)
    return F.zip_with(F.slice(pieces, 1, F.size(pieces) - 1), F.slice(pieces, 2, F.size(pieces)), lambda x, y: F.struct(x.alias("l"), y.alias("r")))


def _side_key(pair: Column, left: Column, right: Column) -> Column:
    """So many characters before and after a space."""
    return F.concat(F.right(pair["l"], left), F.lit(" "), F.left(pair["r"], right))


def _grams(word: Column, size: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(word) - size + 1), lambda i: F.substring(word, i, size))


def _rarest(keys: DataFrame, counts: DataFrame) -> DataFrame:
    """``(key, phrase)``: of ``keys(phrase, key)`` the one in fewest places for each phrase; one that is nowhere drops its phrase."""
    met = keys.join(counts, "key", "left")
    best = met.groupBy("phrase").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key")).alias("b"))
    return best.where("b.n > 0").select("b.key", "phrase")


def holding(texts: DataFrame, phrases: DataFrame, *keys: str) -> DataFrame:
    """``(*keys, phrase)``: which of ``phrases(phrase)`` each of ``texts(*keys, text)`` contains; rows with the same keys count as one.

    Few phrases (``DIRECT``) are looked for in a single pass over the texts. For more there is
    a blocking index, so that no text is held against every phrase. A phrase with spaces meets texts by what stands
    around the one of its spaces that is rarest in the texts; whether it is there is looked at in the texts met only.
    One without spaces must lie inside a piece between two spaces, and so meets the texts' vocabulary, by the rarest
    of its grams. There is no bound on phrases, and all meetings are equi-joins. Null and empty phrases are in no text.
    """
    spark = texts.sparkSession
    phrases = phrases.select("phrase").where("phrase <> ''").distinct()
    few = [r.phrase for r in phrases.limit(DIRECT + 1).collect()]
    if len(few) <= DIRECT:
        there = F.array(*[F.when(F.contains("text", F.lit(x)), F.lit(x)) for x in few]).cast("array<string>")
        return texts.select(*keys, F.explode(F.array_compact(there)).alias("phrase")).distinct()
    with_space = F.contains("phrase", F.lit(" "))
    # by the space: as many characters as the phrase has there, at most SIDE; a text offers the sizes in use only
    sides = phrases.where(with_space).select("phrase", F.explode(_pairs(F.col("phrase"))).alias("p"))
    most = lambda c: F.least(F.length(c), F.lit(SIDE))
    sides = sides.withColumns({"a": most("p.l"), "b": most("p.r")}).withColumn("key", _side_key(F.col("p"), F.col("a"), F.col("b"))).select("phrase", "a", "b", "key").distinct()
    shapes = [(r.a, r.b) for r in sides.select("a", "b").distinct().collect()]  # (SIDE + 1) squared at most
    path = f"{new_folder(spark)}/met"
    if shapes:
        offered = F.array_distinct(F.flatten(F.transform(_pairs(F.col("text")), lambda p: F.array(*[_side_key(p, F.lit(a), F.lit(b)) for a, b in shapes]))))
        met = texts.select(*keys, F.explode(offered).alias("key")).join(sides.select("key").distinct(), "key").distinct()
        met.write.parquet(path)
        met = spark.read.parquet(path)
        chosen = _rarest(sides.select("phrase", "key"), met.groupBy("key").agg(F.count("*").alias("n")))
        by_text = met.join(chosen, "key").groupBy(*keys).agg(F.collect_set("phrase").alias("phrases"))
        same = [texts[k].eqNullSafe(by_text[k]) for k in keys]
        asked = texts.join(by_text, reduce(Column.__and__, same)).select(*[texts[k] for k in keys], "text", "phrases")
        spaced = asked.select(*keys, F.explode(F.filter("phrases", lambda x: F.contains(F.col("text"), x))).alias("phrase"))
    else:
        spaced = texts.select(*keys, F.lit(None).cast("string").alias("phrase")).where("false")
    # by the vocabulary
    single = phrases.where(~with_space).withColumn("size", F.least(F.length("phrase"), F.lit(GRAM)))
    single = single.select("phrase", "size", F.explode(F.array_distinct(_grams(F.col("phrase"), F.col("size")))).alias("key"))
    sizes = [r.size for r in single.select("size").distinct().collect()]  # GRAM at most
    pieces = texts.select(*keys, F.explode(F.array_distinct(F.split("text", " ", -1))).alias("piece"))
    if sizes:
        words = pieces.select("piece").distinct()
        long_enough = [F.when(F.length("piece") >= n, _grams(F.col("piece"), F.lit(n))).otherwise(F.array().cast("array<string>")) for n in sizes]
        grams = words.select("piece", F.explode(F.array_distinct(F.concat(*long_enough))).alias("key")).join(single.select("key").distinct(), "key")
        grams.write.parquet(f"{path}-words")
        grams = spark.read.parquet(f"{path}-words")
        chosen = _rarest(single.select("phrase", "key"), grams.groupBy("key").agg(F.count("*").alias("n")))
        inside = grams.join(chosen, "key").where(F.contains("piece", "phrase")).select("piece", "phrase").distinct()
        spaced = spaced.unionByName(pieces.join(inside, "piece").select(*keys, "phrase"))
    return spaced.distinct()


def naming(notes: DataFrame, words: DataFrame) -> DataFrame:
    """``(note_id, token)``: which of the tokens ``words(token)`` each note has, once.

    With few words (``DIRECT``) only notes whose text contains one somewhere are cut into tokens, and only these words leave their row.
    """
    few = [r.token for r in words.select("token").where("token is not null").distinct().limit(DIRECT + 1).collect()]
    if len(few) > DIRECT:
        return tokens(notes).join(words.select("token").distinct(), "token").select("note_id", "token")
    text = fold_accents(F.concat_ws("\n", "title", "body"))
    there = reduce(Column.__or__, [F.contains("text", F.lit(w)) for w in few], F.lit(False))
    own = F.array_distinct(F.filter(found_tokens(F.col("text")), lambda t: t.isin(few) & ~t.rlike("^[0-9]+$")))
    # not by where(): a filter would fold the text once a word
    return notes.select("note_id", text.alias("text")).select("note_id", F.explode(F.when(there, own)).alias("token"))


def match_topics(notes: DataFrame, rules: DataFrame, fields: list[str]) -> DataFrame:
    """``(topic, note_id, content)``: notes that any rule hits; ``content`` tells a word or phrase among them.

    Words meet tokens by an equi-join (``naming``), field values meet front-matter values by another, and phrases meet texts by ``holding``.
    """
    norm = rules.select("topic", "kind", fold_accents(strip_space(F.col("field"))).alias("field"), fold_accents(strip_space(F.col("value"))).alias("value"))
    words = norm.where("kind = 'word'").select("topic", F.col("value").alias("token"))
    by_word = naming(notes, words).join(words, "token").select("topic", "note_id", F.lit(True).alias("content"))
    text = notes.select("note_id", fold_accents(F.concat_ws("\n", "body", "title")).alias("text"))
    phrases = norm.where("kind = 'phrase'").select("topic", "value")
    found = holding(text, phrases.select(F.col("value").alias("phrase")), "note_id")
    by_phrase = found.join(phrases.withColumnRenamed("value", "phrase"), "phrase").select("topic", "note_id", F.lit(True).alias("content"))
    pairs = F.array(*[F.struct(fold_accents(F.lit(f)).alias("field"), fold_accents(F.col(f).cast("string")).alias("value")) for f in fields])
    values = notes.select("note_id", F.explode(pairs).alias("p")).select("note_id", "p.*")
    by_field = values.join(norm.where("kind = 'field'").select("topic", "field", "value"), ["field", "value"]).select("topic", "note_id", F.lit(False).alias("content"))
    return by_word.unionByName(by_phrase).unionByName(by_field).groupBy("topic", "note_id").agg(F.bool_or("content").alias("content"))


def topic_stats(matches: DataFrame, notes: DataFrame, rules: DataFrame) -> DataFrame:
    """Per topic its hits, whether it is structural (all rules are field rules), and the notes' content coverage in percent."""
    kinds = rules.groupBy("topic").agg(F.every(F.col("kind") == "field").alias("structural"))
    hits = matches.groupBy("topic").agg(F.count("*").alias("hits"))
    total = notes.agg(F.count("*").alias("total"))
    content = matches.where("content").agg(F.countDistinct("note_id").alias("covered"))
    coverage = F.broadcast(total.crossJoin(content).select(F.round(100 * F.try_divide("covered", "total"), 1).alias("coverage")))
    return kinds.join(hits, "topic", "left").fillna(0, ["hits"]).crossJoin(coverage)


def blind_spots(matches: DataFrame, notes: DataFrame) -> DataFrame:
    """``(note_id, spot)``: notes with ``no topic`` at all, or with ``only structural`` ones."""
    kinds = matches.groupBy("note_id").agg(F.bool_or("content").alias("content"))
    spot = F.when(F.col("content").isNull(), "no topic").otherwise("only structural")
    return notes.select("note_id").join(kinds, "note_id", "left").where("content is null or not content").select("note_id", spot.alias("spot"))


def stale_topics(existing: DataFrame, rules: DataFrame) -> DataFrame:
    """Generated topic notes ``existing(topic, generated)`` whose topic is no longer in the map."""
    return existing.where("generated").join(rules.select("topic").distinct(), "topic", "left_anti")
