"""Text expressions: folding, tokens, counts, hashes, query variants, abstention and citation patterns."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns, word lists and formats that results depend on.
BASE64_IMAGE = r"(?s)!\[.*?\]\(data:image/[^;]*;base64,[A-Za-z0-9+/=]+\)"
CITATION = r"\[\[(\d+)\]\s*Fuente:\s*([^|]+)\|\s*Sección:\s*([^|]+)\|\s*Líneas:\s*(\d+)-(\d+)\]"
INLINE_CITATION = r"\[\[\d+\][^\]]*\]"
STOP_WORDS = (
    "what is the of in on about how which are was were do does did a an and or to for with by from at that this it "
    "qué cuál cuáles cómo dónde cuando cuándo quién quiénes por para una uno un los las del con que se en el la es son "
    "de al como este esta estos estas"
).split()
ABSTENTION = (
    r"no\s+(?:encuentro|encuentran|se\s+menciona|se\s+especifica|se\s+detalla|se\s+lista|se\s+incluye|está\s+disponible|están\s+disponibles|tengo\s+información|hay\s+información|dispongo)"
    r"|no\s+(?:está|están)\s+(?:presente|disponible|incluido|especificado)"
    r"|(?:not\s+(?:found|available|present|mentioned|covered|described|listed|included|provided|specified|detailed|addressed)\b)"
    r"|(?:(?:cannot|can't|unable\s+to)\s+find)"
    r"|(?:(?:the\s+)?(?:provided\s+)?(?:context|documents?|sources?|corpus)\s+(?:do(?:es)?\s+not|don't|doesn't)\s+(?:contain|include|mention|cover|provide))"
    r"|(?:no\s+information\s+(?:is\s+)?(?:available|found|provided))"
    r"|(?:this\s+information\s+is\s+not\s+(?:available|present|found))"
)


def _fold_table() -> tuple[str, str]:
    """Accented Latin, Greek and Cyrillic letters and their bare forms, from the Unicode decompositions."""
    accented, bare = [], []
    for point in (*range(0xC0, 0x530), *range(0x1E00, 0x2000)):
        parts = unicodedata.normalize("NFD", chr(point))
        base = "".join(c for c in parts if not unicodedata.combining(c))
        if len(parts) > 1 and len(base) == 1:
            accented.append(chr(point))
            bare.append(base)
    return "".join(accented), "".join(bare)


_ACCENTED, _BARE = _fold_table()


def fold(text: Column) -> Column:
    """Lower case without diacritics; letters that have no decomposition stay."""
    return F.translate(F.regexp_replace(F.lower(text), r"\p{Mn}", ""), _ACCENTED, _BARE)


def tokens(text: Column) -> Column:
    """Runs of letters and digits of the folded text."""
    return F.filter(F.split(fold(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def phrases(query: Column) -> Column:
    """A query's phrases, each an array of tokens: signs other than - and _ part words, words are joined by AND."""
    words = F.split(F.trim(F.regexp_replace(query, r"(?U)[^\w\s\-]", " ")), r"\s+")
    return F.filter(F.transform(words, tokens), lambda p: F.size(p) > 0)


def approx_tokens(text: Column) -> Column:
    """A quarter of the characters, one at least."""
    return F.greatest(F.lit(1), F.floor(F.char_length(F.coalesce(text, F.lit(""))) / 4)).cast("int")


def upper_tokens(text: Column) -> Column:
    """An upper bound without a tokenizer: UTF-8 bytes, one at least."""
    return F.greatest(F.lit(1), F.octet_length(F.coalesce(text, F.lit(""))))


def clean_markdown(text: Column) -> Column:
    """The text without embedded base64 images."""
    return F.regexp_replace(text, BASE64_IMAGE, "")


def query_hash(text: Column) -> Column:
    """SHA-256 of the lower-cased query with white space collapsed."""
    return F.sha2(F.trim(F.regexp_replace(F.lower(text), r"\s+", " ")), 256)


def chunk_id(doc_id: Column, line_start: Column, text: Column) -> Column:
    """First 16 hex digits of SHA-1 over document, first line and the first 200 characters."""
    return F.substring(F.sha1(F.concat(doc_id, F.lit(":"), line_start.cast("string"), F.lit(":"), F.substring(text, 1, 200)).cast("binary")), 1, 16)


def key_terms(query: Column) -> Column:
    """Words of a query that are no stop words, lower-cased, without outer punctuation."""
    words = F.split(F.trim(F.regexp_replace(F.lower(query), "[¿?]", "")), r"\s+")
    bare = F.transform(words, lambda w: F.regexp_replace(w, r"^['\"(),.:;]+|['\"(),.:;]+$", ""))
    return F.filter(bare, lambda w: (w != "") & ~w.isin(STOP_WORDS))


def without_stop_words(query: Column) -> Column:
    kept = key_terms(query)
    return F.when(F.size(kept) > 0, F.array_join(kept, " ")).otherwise(query)


def last_terms(query: Column, n: int = 5) -> Column:
    kept = key_terms(query)
    return F.when(F.size(kept) > n, F.array_join(F.slice(kept, -n, n), " ")).when(F.size(kept) > 0, F.array_join(kept, " ")).otherwise(query)


def abstains(answer: Column, trust: Column | None = None) -> Column:
    """Whether an answer declines: 30 characters or fewer, little trust, or a phrase that says so."""
    short = F.char_length(F.trim(F.coalesce(answer, F.lit("")))) <= 30
    phrase = F.coalesce(answer, F.lit("")).rlike("(?iu)" + ABSTENTION)
    return short | phrase if trust is None else short | F.coalesce(trust < 0.25, F.lit(False)) | phrase


def strip_citations(answer: Column) -> Column:
    """The answer without inline citations, the space before punctuation and doubled spaces."""
    bare = F.regexp_replace(answer, INLINE_CITATION, "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r" +([.,;:?!])", "$1"), " {2,}", " "))


def reranker_text(doc_id: Column, heading: Column, text: Column) -> Column:
    """What a cross-encoder reads: document, section (200 characters at most) and text; absent parts are left out."""
    doc, head = F.trim(F.coalesce(doc_id.cast("string"), F.lit(""))), F.substring(F.trim(F.coalesce(heading, F.lit(""))), 1, 200)
    lines = F.concat(F.when(doc != "", F.concat(F.lit("Document: "), doc, F.lit("\n"))).otherwise(""), F.when(head != "", F.concat(F.lit("Section: "), head, F.lit("\n"))).otherwise(""))
    body = F.coalesce(text, F.lit(""))
    return F.when(lines == "", body).otherwise(F.concat(lines, F.lit("\n"), body))


def answer_from(content: Column, reasoning: Column) -> Column:
    """The content, or else the draft answer inside the reasoning (over 50 characters, up to the next numbered section), or else all of it."""
    thought = F.trim(F.coalesce(reasoning, F.lit("")))
    # The markers of a draft answer.
    marks = (
        r"(?is)(?:Draft Response|Respuesta|Final Answer|Answer|Borrador)[^:]*:\s*\n(.*)",
        r"(?is)(?:\d+\.\s*\*\*(?:Draft|Formulate|Synthesize)[^*]*\*\*[^:]*:\s*\n)(.*)",
    )
    drafts = [F.trim(F.regexp_replace(F.regexp_extract(thought, m, 1), r"(?s)\n\d+\.\s+\*\*.*", "")) for m in marks]
    draft = F.coalesce(*[F.when(F.char_length(d) > 50, d) for d in drafts], thought)
    return F.coalesce(F.nullif(F.trim(F.coalesce(content, F.lit(""))), F.lit("")), draft)
