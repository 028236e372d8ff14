"""Text normalisation, tokens and text features as columns (no Python in the data path)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that results depend on: line patterns, leakage patterns, stop sets, keyword lists.
BOILERPLATE = r"(?i)^\s*page\s+\d+\s*(of\s+\d+)?\s*$|^\s*\d+\s*$|^\s*(table of contents|contents)\s*$|^\s*www\.\S+\s*$|^\s*©.*$|^\s*all rights reserved.*$"
LEAKS = {
    "json_field": r'(?i)"(?:children|answer_md|process_md|schemeId|_id)"\s*:',
    "markdown_copy_field": r"(?i)\b(?:answer_md|process_md|benefits_md|documentsRequired_md)\b",
    "html_tag": r"(?i)</?[a-z][^>]*>",
    "escaped_markup": r"(?i)&(?:amp|lt|gt|quot|#\d+);",
}
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
GENERIC_TERMS = (
    "al", "application", "beneficiary", "central", "department", "government", "central government", "government of india", "gram", "india",
    "ministry", "national", "programme", "ri", "sc", "scheme", "state government", "st", "state", "yojana",
)
DOMAIN_KEYWORDS = {
    "information_retrieval": ("retrieval", "bm25", "faiss", "embedding", "indexing", "recall", "precision", "mrr", "ndcg", "ranking", "sparse", "dense"),
    "machine_learning": ("neural", "transformer", "bert", "gpt", "fine-tuning", "attention", "gradient", "loss", "epoch", "training", "inference"),
    "knowledge_graph": ("entity", "relation", "graph", "node", "edge", "ontology", "knowledge base", "triple", "subject", "predicate", "object"),
    "nlp": ("tokenization", "parsing", "ner", "sentiment", "classification", "language model", "corpus", "annotation", "pos tagging"),
}
CATEGORY_RULES = (
    ("terminology_heavy", r"(?i)\b(what does|stand for|acronym|abbreviation)\b"),
    ("entity_relation", r"(?i)\b(how (are|does|do|is)|relation|connect|link|between)\b"),
    ("multi_hop", r"(?i)\b(and|both|as well as|together with)\b.*\?"),
    ("exact_match", r"(?i)\b(what|who|when|where|which|define|definition)\b"),
    ("paraphrase", r"(?i)\b(information|describe|explain|tell me about)\b"),
)


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once a row, even where ``use`` reads it inside a lambda."""
    return F.element_at(F.transform(F.array(value), use), 1)


def clean_text(text: Column) -> Column:
    """Control characters to blanks, boilerplate lines dropped, at most one blank line, stripped. Null stays null."""
    t = F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", " ")
    t = F.array_join(F.filter(F.split(t, "\n"), lambda s: ~s.rlike(BOILERPLATE)), "\n")
    return strip(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"\A\s+|\s+\z", "")


def ascii_tokens(text: Column) -> Column:
    """Runs of a-z and 0-9 in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def ascii_norm(text: Column) -> Column:
    return F.array_join(ascii_tokens(text), " ")


def unicode_norm(text: Column) -> Column:
    """Lower case, everything but letters and digits to one blank."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def organization_key(text: Column) -> Column:
    return unicode_norm(F.replace(text, F.lit("&"), F.lit(" and ")))


def punctuation_free_tokens(text: Column) -> Column:
    """Lower case, ASCII punctuation deleted, split at white space."""
    return F.filter(F.split(F.translate(F.lower(text), PUNCTUATION, ""), r"\s+"), lambda s: s != "")


def word_tokens(text: Column) -> Column:
    """Runs of letters, digits and underscores in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def leak_counts(text: Column) -> dict[str, Column]:
    """How often each machine-serialisation pattern stands in the text (null as empty)."""
    return {k: F.regexp_count(F.coalesce(text, F.lit("")), F.lit(p)) for k, p in LEAKS.items()}


def canonical_url(url: Column) -> Column:
    """Lower-case scheme and host, single slashes, no trailing slash, no fragment; null for a null."""
    u = F.trim(url)
    scheme = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = F.lower(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    path = F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    path = F.regexp_replace(F.regexp_replace(path, "/{2,}", "/"), "/+$", "")
    query = F.regexp_extract(u, r"(\?[^#]*)", 1)
    return F.concat(scheme, F.lit("://"), host, path, query)


def authoritative_host(url: Column, allowed: tuple[str, ...] = ("mygov.in", "www.mygov.in")) -> Column:
    """An https URL under gov.in or nic.in, or of an allowed host."""
    host = F.lower(F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]*)", 1))
    return F.lower(url).startswith("https://") & (host.endswith(".gov.in") | host.endswith(".nic.in") | host.isin(*allowed))


ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&apos;", "'"), ("&nbsp;", "\u00a0"), ("&amp;", "&"))
ARTIFACTS = r"(?i)[{}\[\]]|\b(?:answer_md|chunk_id|doc_id|schemeId|children|list_item|align_justify)\b"


def unescape_strip(text: Column) -> Column:
    """Entities decoded up to three times, line-break tags and written line breaks to line breaks, other tags dropped, white
    space collapsed, blanks, dashes and bars cut from both ends."""
    t = text
    for _ in range(3):
        for entity, sign in ENTITIES:
            t = F.replace(t, F.lit(entity), F.lit(sign))
    t = F.regexp_replace(t, r"(?i)<br\s*/?>", "\n")
    t = F.regexp_replace(t, r"<[^>]+>", " ")
    t = F.regexp_replace(F.replace(t, F.lit("\\n"), F.lit("\n")), "[ \t\u00a0]+", " ")
    return F.regexp_replace(F.regexp_replace(t, r" ?\n ?", "\n"), r"\A[\s|-]+|[\s|-]+\z", "")


def unique_paragraphs(text: Column) -> Column:
    """Lines of a text whose letters and digits (two at least) were in no line before, in order."""
    lines = F.transform(F.split(text, "\n"), lambda p: F.struct(strip(p).alias("paragraph"), ascii_norm(p).alias("key")))
    kept = F.filter(lines, lambda x: F.length(x["key"]) >= 2)
    first = F.filter(F.array_distinct(F.transform(kept, lambda x: x["key"])), lambda k: k != "")
    return F.transform(first, lambda k: F.filter(kept, lambda x: x["key"] == k)[0]["paragraph"])


def markdown_plain(text: Column) -> Column:
    """Markdown images, links, headings, bullets and emphasis reduced to their words."""
    t = F.regexp_replace(text, r"!\[[^\]]*\]\([^)]*\)", " ")
    t = F.regexp_replace(t, r"\[([^\]]+)\]\([^)]*\)", "$1")
    t = F.regexp_replace(t, r"(?m)^[ \t]*#{1,6}[ \t]*", "")
    t = F.regexp_replace(t, r"(?m)^[ \t]*[-*+][ \t]+", "")
    return F.regexp_replace(t, r"[*`]+", "")


def ascii_letter_ratio(text: Column) -> Column:
    """ASCII letters over all letters; 0 without letters."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]+", ""))
    return F.when(letters > 0, F.length(F.regexp_replace(text, r"[^A-Za-z]+", "")) / letters).otherwise(F.lit(0.0))


def extraction_gate(text: Column, least: int = 100, most: int = 500_000, ratio: float = 0.6) -> Column:
    """Why a text is refused, or null if it passes: empty, too_short, too_long, error_page, not_english."""
    t = F.coalesce(text, F.lit(""))
    error = F.lower(F.left(t, F.lit(100_000))).rlike("404 not found|access denied|service unavailable")
    return (
        F.when(F.trim(t) == "", "empty")
        .when(F.length(t) < least, "too_short")
        .when(F.length(t) > most, "too_long")
        .when(error, "error_page")
        .when(ascii_letter_ratio(t) < ratio, "not_english")
    )


def split_words(text: Column) -> Column:
    """White-space separated words."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda s: s != "")


def reading_time(words: Column) -> Column:
    return F.round(words / F.lit(200.0 / 60.0), 2)


def domain_tags(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    tags = F.array(*[F.when(low.rlike("|".join(words)), F.lit(tag)) for tag, words in DOMAIN_KEYWORDS.items()])
    found = F.filter(tags, lambda x: x.isNotNull())
    return F.when(F.size(found) > 0, F.array_join(found, ",")).otherwise("general")


def sentences(text: Column, least: int = 30, most: int = 500) -> Column:
    """Sentences of ``least`` to ``most`` characters, cut after . ! or ? and white space, with single blanks; those with
    traces of serialised records are left out."""
    parts = F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: ~s.rlike(ARTIFACTS))
    plain = F.transform(parts, lambda s: strip(F.regexp_replace(s, r"\s+", " ")))
    fit = F.filter(plain, lambda s: F.length(s).between(least, most))
    return F.transform(fit, lambda s: F.regexp_replace(s, r"""\A[ :;"'-]+|[ :;"'-]+\z""", ""))


def usable_answer(sentence: Column) -> Column:
    """A statement: no question mark, no label or address at its beginning, five lower-case words, no dangling last word."""
    low = F.lower(strip(sentence))
    return (
        ~sentence.contains("?")
        & ~low.rlike(r"^(?:true|false|https?://|central\s+ministry|ministry\s+of|department\s+of)\b")
        & (F.regexp_count(sentence, F.lit(r"\b[a-z]{3,}\b")) >= 5)
        & ~low.rlike(r"\b(?:the|a|an|to|of|in|on|for|prescribed)\W*$")
    )


def category(question: Column, stored: Column | None = None) -> Column:
    """The stored label unless it is missing or unknown, else the first rule that matches, else unknown."""
    rule = F.lit(None).cast("string")
    for name, pattern in CATEGORY_RULES[::-1]:
        rule = F.when(question.rlike(pattern), name).otherwise(rule)
    rule = F.coalesce(rule, F.lit("unknown"))
    if stored is None:
        return rule
    return F.when(stored.isNotNull() & ~stored.isin("", "unknown"), stored).otherwise(rule)


def capitalized_phrases(text: Column) -> Column:
    """Distinct capitalised phrases of over three characters in order of appearance, in lower case."""
    found = F.regexp_extract_all(text, F.lit(r"[A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+)*"), F.lit(0))
    return F.array_distinct(F.transform(F.filter(found, lambda s: F.length(s) > 3), F.lower))


def heading_like(line: Column) -> Column:
    """3 to 100 characters, at most 12 words, in capitals, numbered or in title case."""
    n = F.size(split_words(line))
    numbered = line.rlike(r"^\d+(\.\d+)*[.)]?\s+\S")
    title = line.rlike(r"^(?:[A-Z][\p{L}\p{N}'-]*|(?:of|and|the|for|in|to|on|a|an))(?:\s+(?:[A-Z][\p{L}\p{N}'-]*|of|and|the|for|in|to|on|a|an))*$") & line.rlike("^[A-Z]")
    capitals = (F.upper(line) == line) & line.rlike("[A-Z]")
    return F.length(line).between(3, 100) & (n <= 12) & ~line.rlike(r"[.;:,]$") & (capitals | numbered | title)


def excerpt(text: Column, needle: Column, width: int = 220) -> Column:
    """``width`` characters around the first occurrence of ``needle``, a third before it, or of the beginning if there is none; white space is
    collapsed, case has no say. An empty or null needle gives null."""
    plain = strip(F.regexp_replace(text, r"\s+", " "))
    at = F.instr(F.lower(plain), F.lower(needle))
    start = F.greatest(F.lit(1), at - width // 3)
    return F.when(F.length(needle) > 0, F.substr(plain, start, F.lit(width)))


def initials(phrase: Column) -> Column:
    """First letters of the words of a phrase."""
    return F.array_join(F.transform(split_words(phrase), lambda w: F.left(w, F.lit(1))), "")
