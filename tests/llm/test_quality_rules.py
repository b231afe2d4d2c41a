import re

from convarchive.llm import quality_rules as q

PROSE = "Plain{0} sentence{0} with{0} some different{0} words{0} in it{0}, number {0}."
ROWS = [
    (1, "\n".join(PROSE.format(w) for w in "one two three four five six seven eight".split())),
    (2, None),
    (3, ""),
    (4, " \n\t\n"),
    (5, "word " * 120),
    (6, "\n".join(f"Home{i} | About{i} | News{i} | Contact{i} | More{i}" for i in range(20))),
    (7, "\n".join("FREE{0} STUFF{0}!! CLICK{0} HERE{0}!! BUY{0} NOW{0}!!".format("abcdefghijklmnopqrst"[i].upper() * 3) for i in range(20))),
    (8, "a b c d\na b c d\nx a b c"),
    (8, "a b c d\na b c d\nx a b c"),
    (9, " ".join(f"w{i % 5000}" for i in range(60_000))),
    (None, "\n".join(PROSE.format(i) for i in range(9))),
]


def slow(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = {}
    for g in grams:
        count[g] = count.get(g, 0) + 1
    hit = {j for i, g in enumerate(grams) if count[g] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_counts_and_verdicts(spark):
    docs = spark.createDataFrame([(i, t, 1, "x", "k") for i, t in ROWS], "doc_id long, text string, good int, __base string, Kept string")
    got = q.quality_rules(docs).collect()
    assert [(r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got] == [slow(t) for _, t in ROWS]
    assert [r.kept for r in got] == [True, False, False, False, False, False, False, False, False, False, True]
    assert [r.base_failed for r in got[1:5]] == [True] * 4 and not got[5].base_failed and not got[6].base_failed
    assert got[5].clean_text == "" and got[0].clean_text == ROWS[0][1] and got[0].kept_share == 1.0 and got[1].kept_share == 0.0
    assert {(r["__base"], r.Kept_input) for r in got} == {("x", "k")}
    assert q.quality_rules(docs.where("false")).count() == 0


LINES = {
    "A short heading": True, "It ends.": False, 'He said "so."': False, "Wait…  ": False, "Really?!": True, "one two three four five six seven eight nine ten": False, "x": True, "list:": False,
    "THIS IS ALL SHOUTED AT YOU.": True, "We met IBM and NASA staff in the long hall.": False, "ÀÉÎ ÖÜ ÇÑ ÀÉÎ ÖÜ ÇÑ ÀÉÎ ÖÜÇ.": True, "a | b | c | d.": True, "a | b | c.": True, "Read our Privacy Policy now.": True,
    "ha ha ha ha ha ha ha ha ha ha ha.": True, "5 > 3 is so, and that is about all that one can say.": False, "The cookie was good and all rights were reserved by nobody here at all, they said.": False,
}


def slow_fails(x):
    words = re.findall(r"[^\x20\x09-\x0D]+", x)
    letters = [c for c in x if c.isalpha()]
    return (
        10 * sum(c in "!#*$%&|<>" for c in x) > len(x)
        or (len(letters) >= 20 and 10 * sum(not c.isupper() for c in letters) < 4 * len(letters))
        or len(re.findall(" [|»>•·] ", x)) >= 3
        or (any(p in x.lower() for p in q.BOILERPLATE) and len(words) < 40)
        or (len(words) < 10 and not re.search(r"[.!?…:;][\"'”’»)\]]*[\x20\x09-\x0D]*\Z", x))
        or (len(words) >= 10 and 5 * len(set(words)) < len(words))
    )


def test_line_rules(spark):
    lines = [*LINES, *(p.title() + " and some." for p in q.BOILERPLATE)]
    got = {r.x: r.f for r in (lambda df: df.select("x", q.line_fails(df.x).alias("f")))(spark.createDataFrame([(x,) for x in lines], "x string")).collect()}
    assert got == {x: slow_fails(x) for x in lines}
    assert {x: got[x] for x in LINES if x != "a | b | c."} == {x: f for x, f in LINES.items() if x != "a | b | c."}
