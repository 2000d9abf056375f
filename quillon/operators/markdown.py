"""Markdown documents: front matter, validation, headings and structure-aware chunks.

One pass per document without a shuffle: what a chunk is depends on all that came before it in the document, so these
steps run in Arrow batches; line-level statistics that need no state are built-in expressions.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.config import DEFAULTS
from quillon.runtime import ship_package

try:
    import yaml
except ImportError:  # front matter is then reported as unchecked
    yaml = None

# Patterns, titles and limits that results depend on.
HEADING = re.compile(r"^(#{1,6})\s+(.+)")
NUMBERED = re.compile(r"^\d+\.\s+\S")
TABLE_RULE = re.compile(r"^\|[\s\-:|]+\|")
CONTENTS = ("contents", "table of contents", "índice", "toc")
LIMITS = {"section_tokens": 1600, "chunks": 200, "table_rows": 200, "line_length": 500, "content_tokens": 50, "long_paragraph": 200}


def n_tokens(text: str) -> int:
    return max(1, len(text) // 4) if text.strip() else 1


def is_table(line: str) -> bool:
    return line.strip().startswith("|")


def is_numbered(line: str) -> bool:
    return bool(NUMBERED.match(line.strip()))


@dataclass
class Heading:
    level: int
    title: str
    line: int  # 1-based
    path: str = ""
    parent: int = -1  # number of the parent heading


def headings(text: str, skip_fences: bool = False) -> list[Heading]:
    """Headings by line, indented ones too, each with its path: the nearest earlier heading of a smaller level is the parent."""
    out: list[Heading] = []
    open_at: list[int] = []
    fenced = False
    for i, raw in enumerate(text.split("\n"), 1):
        line = raw.strip()
        if line.startswith("```"):
            fenced = not fenced
        m = None if fenced and skip_fences else HEADING.match(line)
        if not m:
            continue
        h = Heading(len(m[1]), m[2].strip(), i)
        while open_at and out[open_at[-1]].level >= h.level:
            open_at.pop()
        if open_at:
            h.parent = open_at[-1]
        h.path = f"{out[h.parent].path} > {h.title}" if h.parent >= 0 else h.title
        open_at.append(len(out))
        out.append(h)
    return out


@dataclass
class Section:
    text: str
    path: str
    title: str
    position: float
    level: int
    parent: int
    first: int
    last: int
    tokens: int = field(init=False)

    def __post_init__(self) -> None:
        self.tokens = n_tokens(self.text)


def sections(text: str) -> list[Section]:
    """What stands from each heading to the next, tables of contents left out."""
    lines, marks = text.split("\n"), headings(text)
    ends = [h.line - 1 for h in marks[1:]] + [len(lines)]
    out = []
    for h, end in zip(marks, ends):
        body = "\n".join(lines[h.line - 1 : end]).strip()
        if body and h.title.lower() not in CONTENTS:
            out.append(Section(re.sub(r"\n{3,}", "\n\n", body), h.path, h.title, (h.line - 1) / len(lines), h.level, h.parent, h.line, end))
    return out


def merge_siblings(parts: list[Section], cap: int) -> list[Section]:
    """Consecutive sections of one level under one parent as one, up to ``cap`` tokens in sum; chapters stay apart."""
    out: list[list[Section]] = []
    total = 0
    for s in parts:
        head = out[-1][0] if out else None
        if head and head.parent >= 0 and (s.level, s.parent) == (head.level, head.parent) and total + s.tokens <= cap:
            out[-1].append(s)
            total += s.tokens
        else:
            out.append([s])
            total = s.tokens
    merged = []
    for group in out:
        a, b = group[0], group[-1]
        path = a.path
        if a.path != b.path:
            above, mark, _ = a.path.rpartition(" > ")
            path = f"{above}{mark}{a.title} … {b.title}"
        merged.append(a if len(group) == 1 else Section("\n\n".join(s.text for s in group), path, a.title, a.position, a.level, a.parent, a.first, b.last))
    return merged


def segments(text: str) -> list[str]:
    """Paragraphs; long ones, and those with numbered lists, by line, a list's lines together."""
    out: list[str] = []
    for paragraph in filter(None, (p.strip() for p in re.split(r"\n\s*\n", text))):
        lines = [line.strip() for line in paragraph.split("\n")]
        numbered = [is_numbered(line) for line in lines]
        if not any(numbered) and n_tokens(paragraph) <= LIMITS["long_paragraph"]:
            out.append(paragraph)
            continue
        run = False
        for line, listed in zip(lines, numbered):
            if listed and run:
                out[-1] += "\n" + line
            else:
                out.append(line)
            run = listed
    return out


@dataclass
class Chunk:
    doc_id: str
    text: str
    path: str
    kind: str
    position: float
    tokens: int
    first: int
    last: int
    named_by: str = ""

    @property
    def chunk_id(self) -> str:
        return hashlib.sha1(f"{self.doc_id}:{self.first}:{(self.named_by or self.text)[:200]}".encode()).hexdigest()[:16]


def split_section(s: Section, doc_id: str, most: int, overlap: int) -> Iterator[Chunk]:
    """A table or a section that fits is one chunk; else segments are packed, each chunk beginning with the last one's tail."""
    if not s.text.strip():
        return
    table = any(is_table(line) for line in s.text.split("\n"))
    if table or s.tokens <= most:
        yield Chunk(doc_id, s.text.strip(), s.path, "tabla" if table else "texto", s.position, s.tokens, s.first, s.last, s.text)
        return
    parts = segments(s.text)
    sizes = [n_tokens(p) for p in parts]
    per = max(1, s.last - s.first) / len(parts)

    def chunk(a: int, b: int, end: int) -> Iterator[Chunk]:
        text = "\n".join(parts[a:b]).strip()
        if text:
            yield Chunk(doc_id, text, s.path, "texto", s.position, n_tokens(text), max(s.first, s.first + int(a * per)), end)

    a = held = 0
    for b, size in enumerate(sizes):
        while held + size > most and b > a:
            yield from chunk(a, b, min(s.last, s.first + int(b * per)))
            start, tail = b, 0
            while start > a and tail + sizes[start - 1] <= overlap:
                start -= 1
                tail += sizes[start]
            if start == a:
                start += 1
            a, held = start, sum(sizes[start:b])
        held += size
    yield from chunk(a, len(parts), s.last)


def fold_tiny(chunks: list[Chunk], least: int) -> list[Chunk]:
    """Chunks under ``least`` tokens go to the end of the one before; the first stays. Line ends follow the text."""
    out: list[Chunk] = []
    for c in chunks:
        if out and c.tokens < least:
            p = out[-1]
            p.text = p.named_by = f"{p.text}\n\n{c.text}"
            p.tokens, p.last = n_tokens(p.text), max(p.last, c.last)
        else:
            out.append(c)
    return out


def chunk_text(text: str, doc_id: str, most: int = 0, overlap: int = 0, least: int = DEFAULTS.chunk_min_tokens) -> list[Chunk]:
    """Chunks of one document; 0 stands for the default. Without headings the whole text is one section and tiny chunks stay."""
    most, overlap = most or DEFAULTS.chunk_max_tokens, overlap or DEFAULTS.chunk_overlap
    if not text or not text.strip():
        return []
    if not headings(text):
        return list(split_section(Section(text, "Document", "Document", 0.0, 0, -1, 0, 0), doc_id, most, overlap))
    parts = merge_siblings(sections(text), 2 * most)
    return fold_tiny([c for s in parts for c in split_section(s, doc_id, most, overlap)], least)


CHUNKS = "chunk_id string, doc_id string, text string, heading_path string, tipo string, posicion_relativa double, n_tokens int, line_start int, line_end int"


def chunk_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 0, overlap: int = 0) -> DataFrame:
    """Chunk rows of all documents; blank and null texts have none. No shuffle."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["chunk_id", "doc_id", "text", "heading_path", "tipo", "posicion_relativa", "n_tokens", "line_start", "line_end"]
        kinds = [pa.string()] * 5 + [pa.float64()] + [pa.int32()] * 3
        for batch in batches:
            rows = [c for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for c in chunk_text(t or "", i or "", most, overlap)]
            cols = [[c.chunk_id for c in rows], [c.doc_id for c in rows], [c.text for c in rows], [c.path for c in rows], [c.kind for c in rows], [c.position for c in rows], [c.tokens for c in rows], [c.first for c in rows], [c.last for c in rows]]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    return docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, CHUNKS)


# -- front matter

def front_matter(text: str) -> tuple[str, dict]:
    """(state, fields): missing, unclosed, unchecked, invalid, not_mapping or ok."""
    lines = text.splitlines()
    if not lines or lines[0].strip() != "---":
        return "missing", {}
    end = next((i for i, line in enumerate(lines[1:], 1) if line.strip() == "---"), None)
    if end is None:
        return "unclosed", {}
    if yaml is None:
        return "unchecked", {}
    try:
        found = yaml.safe_load("\n".join(lines[1:end]))
    except Exception:  # any reader's error is the document's
        return "invalid", {}
    return ("ok", found) if isinstance(found, dict) else ("not_mapping", {})


def _word(value: object) -> str | None:
    return str(value).strip() or None if value is not None else None


FRONT = "doc_id string, title string, domain string, source_type string, language string, version string, tags array<string>, all_tags array<string>, front_state string"


def parse_front_matter(docs: DataFrame, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """path with the front matter's fields; a missing title falls back to the first H1, tags are normalised, all_tags has the derived ones too."""
    ship_package(docs.sparkSession)

    def one(text: str) -> list:
        state, f = front_matter(text)
        tags = f.get("tags")
        tags = [tags] if isinstance(tags, str) else tags if isinstance(tags, list) else []
        tags = list(dict.fromkeys(t.strip() for t in tags if isinstance(t, str) and t.strip()))
        title = _word(f.get("title"))
        if title is None:
            m = re.search(r"^#\s+(.*)", text, re.M)
            title = _word(m[1]) if m else None
        domain, kind, lang, version = (_word(f.get(k)) for k in ("domain", "source_type", "language", "version"))
        derived = [f"{k}:{v.lower()}" for k, v in (("domain", domain), ("source_type", kind), ("lang", lang)) if v] + ([f"version:{version}"] if version else [])
        return [_word(f.get("doc_id")), title, domain, kind, lang, version, tags, sorted({*tags, *derived}), state]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string()] * 6 + [pa.list_(pa.string())] * 2 + [pa.string()]
        for batch in batches:
            cols = list(zip(*(one(t or "") for t in batch.column(1).to_pylist()))) or [()] * 9
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds)]], ["path", *[x.split()[0] for x in FRONT.split(", ")]])

    own = docs.select(F.col(path_col).alias("path"), F.col(text_col).alias("text"))
    return own.mapInArrow(run, f"path string, {FRONT}")


# -- validation

def issues(text: str | None, readable: bool = True) -> list[tuple[str, str, int | None]]:
    """(severity, code, line) of everything the document contract objects to."""
    if not readable:
        return [("ERROR", "encoding_error", None)]
    if not text or not text.strip():
        return [("ERROR", "empty_file", None)]
    lines, found = text.splitlines(), []
    if n_tokens(text) < LIMITS["content_tokens"]:
        found.append(("WARN", "min_content", None))
    state, f = front_matter(text)
    by_state = {
        "missing": ("WARN", "frontmatter_missing", None), "unclosed": ("WARN", "frontmatter_unclosed", 1), "unchecked": ("INFO", "yaml_unavailable", 1),
        "invalid": ("ERROR", "frontmatter_invalid_yaml", 1), "not_mapping": ("ERROR", "frontmatter_not_mapping", 1),
    }
    found += [by_state[state]] if state in by_state else _field_issues(f)
    if not any(re.match(r"^#\s+\S", line) for line in lines):
        found.append(("WARN", "missing_title", None))
    marks = [(i, len(m[1])) for i, m in ((i, re.match(r"^(#{1,6})\s+", line)) for i, line in enumerate(lines)) if m]
    found += [("WARN", "heading_hierarchy_skip", i + 1) for (_, before), (i, level) in zip(marks, marks[1:]) if level > before + 1]
    ends = [i for i, _ in marks[1:]] + [len(lines)]
    found += [("WARN", "section_too_long", i + 1) for (i, _), end in zip(marks, ends) if n_tokens("\n".join(lines[i:end])) > LIMITS["section_tokens"]]
    start = rows = 0
    for i, line in enumerate([*lines, ""], 1):
        if is_table(line):
            start = start or i
            rows += not TABLE_RULE.match(line.strip())
        elif start:
            if rows > LIMITS["table_rows"]:
                found.append(("WARN", "large_table", start))
            start = rows = 0
    found += [("INFO", "long_line", i) for i, line in enumerate(lines, 1) if len(line) > LIMITS["line_length"]]
    if max(1, n_tokens(text) // DEFAULTS.chunk_max_tokens) > LIMITS["chunks"]:
        found.append(("WARN", "estimated_chunks_high", None))
    return found


def _field_issues(f: dict) -> list[tuple[str, str, int | None]]:
    out = [("ERROR", "frontmatter_scope_violation", 1) for k in ("dataset", "dataset_id") if k in f]
    blank = lambda k: not f.get(k) or not str(f[k]).strip()
    if blank("doc_id"):
        out.append(("ERROR", "frontmatter_missing_doc_id", 1))
    out += [("WARN", f"frontmatter_missing_{k}", 1) for k in ("title", "domain", "source_type", "language") if blank(k)]
    tags = f.get("tags")
    if tags is not None and not isinstance(tags, list):
        return [*out, ("ERROR", "frontmatter_tags_not_list", 1)]
    seen: set[str] = set()
    for tag in tags or []:
        if not isinstance(tag, str):
            out.append(("ERROR", "frontmatter_tag_not_string", 1))
            continue
        bare = tag.strip()
        if not bare:
            out.append(("WARN", "frontmatter_tag_empty", 1))
        elif bare != tag:
            out.append(("WARN", "frontmatter_tag_whitespace", 1))
        if bare in seen:
            out.append(("WARN", "frontmatter_tag_duplicate", 1))
        seen.add(bare)
    return out


def validate(docs: DataFrame, path_col: str = "path", text_col: str = "text", ok_col: str | None = None) -> DataFrame:
    """(path, severity, code, line_number), a row per issue; ``ok_col`` is false where a file was no UTF-8."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p, *i) for p, t, ok in zip(*(batch.column(k).to_pylist() for k in range(3))) for i in issues(t, ok)]
            cols = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.string(), pa.string(), pa.int32()))], ["path", "severity", "code", "line_number"])

    own = docs.select(F.col(path_col).cast("string").alias("path"), F.col(text_col).alias("text"), (F.col(ok_col) if ok_col else F.lit(True)).alias("ok"))
    return own.mapInArrow(run, "path string, severity string, code string, line_number int")


def blocked(report: DataFrame, strict: bool = False) -> DataFrame:
    """(path) of documents that must not be ingested: any error, with ``strict`` any warning too."""
    return report.where(F.col("severity").isin(*(("ERROR", "WARN") if strict else ("ERROR",)))).select("path").distinct()


def heading_tree(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, line, level, path): every heading with the titles above it; null texts have none."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, h) for i, t in enumerate(batch.column(1).to_pylist()) for h in headings(t or "")]
            own = batch.column(0).take(pa.array([i for i, _ in rows], pa.int64()))
            cols = [pa.array([getattr(h, a) for _, h in rows], k) for a, k in (("line", pa.int32()), ("level", pa.int32()), ("path", pa.string()))]
            yield pa.RecordBatch.from_arrays([own, *cols], ["doc_id", "line", "level", "path"])

    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return own.mapInArrow(run, own.select("doc_id").schema.add("line", "integer").add("level", "integer").add("path", "string"))


# -- built-in line statistics

def lines_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, line_no, line): a row per line, from 1."""
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("p", "line")).select("doc_id", (F.col("p") + 1).alias("line_no"), "line")


def heading_level(line: Column) -> Column:
    return F.length(F.regexp_extract(F.trim(line), r"^(#{1,6})\s+.+", 1))


def inspect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_lines, n_headings, n_tables, n_tokens, estimated_chunks): tables are runs of table lines. All within the row: nothing is shuffled."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.char_length(text).alias("c"), F.split(text, "\n").alias("lines"))
    rows = rows.withColumn("table", F.transform("lines", lambda x: F.trim(x).startswith("|")))
    edges = F.filter("table", lambda t, i: t & ~F.coalesce(F.get("table", i - 1), F.lit(False)))
    tokens = F.greatest(F.lit(1), F.floor(F.col("c") / 4)).cast("long")
    return rows.select(
        "doc_id", F.size("lines").cast("long").alias("n_lines"), F.size(F.filter("lines", lambda x: heading_level(x) > 0)).cast("long").alias("n_headings"), F.size(edges).cast("long").alias("n_tables"),
        tokens.alias("n_tokens"), F.greatest(F.lit(1), F.floor(tokens / DEFAULTS.chunk_max_tokens)).cast("long").alias("estimated_chunks"),
    )


def line_lengths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, long_lines, longest): lines over the limit, and the longest one's characters, within the row."""
    sizes = F.transform(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"), lambda x: F.char_length(x))
    rows = docs.select(F.col(id_col).alias("doc_id"), sizes.alias("sizes"))
    return rows.select("doc_id", F.size(F.filter("sizes", lambda n: n > LIMITS["line_length"])).cast("long").alias("long_lines"), F.array_max("sizes").cast("long").alias("longest"))


def preview(chunks: DataFrame, limit: int) -> DataFrame:
    """The first chunks with 120 characters each: a dry run's listing."""
    return chunks.select("chunk_id", "doc_id", "heading_path", "n_tokens", F.substring("text", 1, 120).alias("preview")).limit(limit)
