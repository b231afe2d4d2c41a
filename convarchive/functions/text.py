"""Column functions on text. White space is Unicode-unaware: the six ASCII spaces, as both engines see ``\\s``."""

from __future__ import annotations

from unicodedata import normalize

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Combining marks that count as accents.
MARKS = "".join(map(chr, range(0x300, 0x370)))


def _folded() -> tuple[str, str]:
    """All letters that decompose into one character and accents, and these characters; the accents last, with nothing for them."""
    pairs = {}
    for code in (*range(0xC0, 0x2150), *range(0x2C60, 0x2E00), *range(0xF900, 0xFB50)):
        bare = "".join(c for c in normalize("NFD", chr(code)) if c not in MARKS)
        if len(bare) == 1 and bare != chr(code):
            pairs[chr(code)] = bare
    return "".join(pairs) + MARKS, "".join(pairs.values())


ACCENTED, PLAIN = _folded()
#: Titles that say nothing, in lower case.
GENERIC_TITLES = [
    "", "conversación", "conversation", "new chat", "conversación nueva",
    "untitled", "sin título", "chat", "chatgpt conversation",
]


def strip_space(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def collapse_space(c: Column) -> Column:
    """Trimmed, runs of white space as one space: text equality of message fingerprints."""
    return F.regexp_replace(strip_space(c), r"\s+", " ")


def split_words(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda t: t != "")


def word_count(c: Column, mode: str = "split") -> Column:
    """``split``: white-space words (merging, posts); ``regex``: runs of letters, digits and underscores (import)."""
    if mode == "regex":
        return F.regexp_count(c, F.lit(r"[\p{L}\p{N}_]+"))
    return F.regexp_count(c, F.lit(r"\S+"))


def fold_accents(c: Column) -> Column:
    """Lower case without accents: text equality of topics."""
    low = F.lower(c)
    return F.when(F.length(low) == F.octet_length(low), low).otherwise(F.translate(low, ACCENTED, PLAIN))


def found_tokens(folded: Column) -> Column:
    """What ``topic_tokens`` finds in a text without accents, repeats and digits included."""
    return F.regexp_extract_all(folded, F.lit(r"([a-z0-9][a-z0-9_-]{2,})"), 1)


def topic_tokens(c: Column) -> Column:
    """Distinct normalised tokens of three characters or more, digits-only ones left out."""
    return F.array_distinct(F.filter(found_tokens(fold_accents(c)), lambda t: ~t.rlike("^[0-9]+$")))


def slugify(c: Column, mode: str = "unicode", limit: int = 80) -> Column:
    """``unicode``: words of any script joined by hyphens; ``ascii``: accents folded, other letters dropped."""
    if mode == "ascii":
        bare = F.regexp_replace(fold_accents(c), r"[^a-z0-9]+", "-")
    else:
        bare = F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_]+", "-")
    return F.substring(F.regexp_replace(bare, r"^-+|-+$", ""), 1, limit)


def safe_name(c: Column, limit: int = 120) -> Column:
    """A file name: letters, digits and ``-_.() ``."""
    return F.substring(strip_space(F.regexp_replace(c, r"[^\p{L}\p{N}\-_.() ]", "")), 1, limit)


def note_tag(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"[^\p{L}\p{N}_/]+", "-"), r"^-+|-+$", "")


def to_number(c: Column) -> Column:
    """A cell of a statistics file; blank and ``_-`` are null."""
    bare = strip_space(c)
    return F.when((bare != "") & (bare != "_-"), F.regexp_replace(bare, ",", "")).try_cast("double")


def normalize_newlines(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"\r\n?", "\n"), r"\n{3,}", "\n\n")


def title_markers(c: Column, markers: tuple[str, ...] = ("Cover", "Remix", "Edit", "Extended", "Mashup")) -> Column:
    """Lineage markers of a title such as ``(Cover)``, each as often as it occurs."""
    counts = [F.struct(F.lit(m).alias("marker"), F.regexp_count(c, F.lit(rf"\({m}\)")).alias("n")) for m in markers]
    return F.filter(F.array(*counts), lambda x: x["n"] > 0)


def has_private_use(c: Column) -> Column:
    return c.rlike("[-]")


def has_nul(c: Column) -> Column:
    return c.contains("\x00")


def raw_json_lines(c: Column) -> Column:
    """How many lines are JSON objects with a content type: blocks that were never rendered."""
    lines = F.filter(F.split(c, "\n"), lambda x: x.startswith("{") & x.contains('"content_type"'))
    return F.size(F.filter(lines, lambda x: F.get_json_object(x, "$.content_type").isNotNull()))


def epoch_date(c: Column) -> Column:
    return F.to_date(F.timestamp_seconds(c.cast("double")))


def smart_title(title: Column, first_user_text: Column) -> Column:
    """A generic title gives way to the first eight tokens of the first user message."""
    tokens = F.slice(F.regexp_extract_all(F.coalesce(first_user_text, F.lit("")), F.lit(r"([\p{L}\p{N}_]+)"), 1), 1, 8)
    made = F.when(F.size(tokens) > 0, F.array_join(tokens, " "))
    generic = F.lower(strip_space(F.coalesce(title, F.lit("")))).isin(GENERIC_TITLES)
    return F.when(generic, F.coalesce(made, title)).otherwise(title)


def render_parts(parts: Column) -> Column:
    """Text of content parts ``array<struct<kind, text, pointer>>``: texts, image pointer tokens, notices for the rest."""
    shown = F.transform(
        parts,
        lambda p: F.when(p["kind"] == "text", p["text"])
        .when(p["kind"] == "image", F.concat(F.lit("[image:"), p["pointer"], F.lit("]")))
        .otherwise(F.concat(F.lit("[unrendered "), p["kind"], F.lit("]"))),
    )
    return F.array_join(F.filter(shown, lambda x: x != ""), "\n")


def attachment_lines(attachments: Column) -> Column:
    """Lines for non-image attachments ``array<struct<name, mime, tokens>>``."""
    files = F.filter(attachments, lambda a: ~F.coalesce(a["mime"], F.lit("")).startswith("image/"))
    size = lambda a: F.when(a["tokens"].isNotNull(), F.concat(F.lit(" ("), a["tokens"].cast("string"), F.lit(" tokens)"))).otherwise("")
    return F.array_join(F.transform(files, lambda a: F.concat(F.lit("- attached: "), a["name"], size(a))), "\n")


def quoted_extract(name: Column, extract: Column, limit: int = 800) -> Column:
    """An attachment's name and the start of its extracted text, cut at ``limit``."""
    cut = F.when(F.length(extract) > limit, F.concat(F.substring(extract, 1, limit), F.lit("…"))).otherwise(extract)
    return F.concat(F.lit("> "), name, F.lit("\n> "), F.regexp_replace(cut, "\n", "\n> "))


def infer_date(front_date: Column, file_name: Column, title: Column) -> Column:
    """A note's date: front matter, else file name, else title, else ``0000-00-00``."""
    found = [F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), r"(\d{4}-\d{2}-\d{2})", 1), F.lit("")) for c in (front_date, file_name, title)]
    return F.coalesce(*found, F.lit("0000-00-00"))


def sniff_ext(content: Column) -> Column:
    """File type by its first bytes."""
    head = F.hex(F.substring(content, 1, 12))
    return (
        F.when(head.startswith("89504E470D0A1A0A"), "png")
        .when(head.startswith("FFD8FF"), "jpg")
        .when(head.startswith("47494638"), "gif")
        .when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "webp")
        .when(F.substring(head, 9, 8) == "66747970", "mp4")
        .otherwise("bin")
    )


def is_asset(content: Column) -> Column:
    """False for empty files and for unknown types whose head looks like HTML, JSON or XML."""
    head = F.lower(F.trim(F.decode(F.substring(content, 1, 512), "ISO-8859-1")))
    markup = head.rlike(r"^\s*(<!doctype|<html|<\?xml|\{|\[)")
    return (F.length(content) > 0) & ~((sniff_ext(content) == "bin") & markup)


def unwrap(json: Column) -> Column:
    """The value of ``{"status": …, "value": …}``, or of a bare number, as double; anything else is null."""
    inner = F.get_json_object(json, "$.value")
    return F.coalesce(inner.try_cast("double"), json.try_cast("double"))


def excerpt(body: Column, subtitle: Column, n: int = 50) -> Column:
    """The first ``n`` words of a post without headings, subtitle, images, quotes, tables and rules; links as text."""
    lines = F.filter(F.split(body, "\n"), lambda x: ~x.rlike(r"^\s*(#|!\[|>|\||---|\*\*\*|$)") & (strip_space(x) != F.coalesce(subtitle, F.lit(""))))
    text = F.regexp_replace(F.array_join(lines, " "), r"\[([^\]]*)\]\([^)]*\)", "$1")
    return F.array_join(F.slice(split_words(text), 1, n), " ")


def normalize_role(c: Column) -> Column:
    """Roles of all providers in one vocabulary; unknown ones stay, in lower case."""
    low = F.lower(c)
    return F.when(low == "human", "user").when(low.isin("ai", "bot", "model", "copilot"), "assistant").otherwise(low)
