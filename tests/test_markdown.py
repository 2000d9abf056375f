"""Chunker, headings, front matter and validation on small documents."""

from quillon.operators import markdown as M

DOC = "intro\n# One\ntext\n## A\nalpha\n## B\nbeta\n### deep\nx\n# Two\n| a | b |\n|---|---|\n| 1 | 2 |\n"


def test_headings_and_paths():
    got = [(h.level, h.path, h.line) for h in M.headings(DOC + "  ## Indented\n```\n# code\n```\n")]
    assert got == [(1, "One", 2), (2, "One > A", 4), (2, "One > B", 6), (3, "One > B > deep", 8), (1, "Two", 10), (2, "Two > Indented", 14), (1, "code", 16)]
    assert [h.title for h in M.headings("```\n# code\n```\n# real", skip_fences=True)] == ["real"]


def test_text_before_first_heading_and_contents_go():
    out = M.chunk_text("front\n# Contents\n1. x\n# Real\n" + "word " * 60, "d")
    assert len(out) == 1 and out[0].path == "Real" and "front" not in out[0].text


def test_no_heading_is_one_section_with_line_zero():
    (c,) = M.chunk_text("just some text", "d")
    assert (c.path, c.position, c.first, c.last, c.kind) == ("Document", 0.0, 0, 0, "texto")


def test_siblings_merge_chapters_do_not():
    body = "w " * 120
    out = M.chunk_text(f"# C\n{body}\n## A\n{body}\n## B\n{body}\n# D\n{body}", "d")
    assert [c.path for c in out] == ["C", "C > A … B", "D"]


def test_table_stays_whole():
    rows = "\n".join(f"| {i} | x |" for i in range(2000))
    out = M.chunk_text(f"# T\n{rows}", "d")
    assert len(out) == 1 and out[0].kind == "tabla"


def test_packing_bounds_overlap_and_progress():
    text = "# H\n\n" + "\n\n".join(f"p{i} " + "lorem " * 60 for i in range(40))
    out = M.chunk_text(text, "d", most=300, overlap=100)
    assert len(out) > 5 and all(c.tokens <= 400 for c in out)
    for a, b in zip(out, out[1:]):
        assert a.text.split("\n")[-1] == b.text.split("\n")[0]
    assert {f"p{i}" for i in range(40)} <= {w for c in out for w in c.text.split() if w[0] == "p"}
    assert all(a.first <= b.first for a, b in zip(out, out[1:]))


def test_numbered_lists_stay_together():
    assert M.segments("1. a\n2. b\n\nplain\nmore") == ["1. a\n2. b", "plain\nmore"]
    assert M.segments("see\n1. a\n2. b\nend") == ["see", "1. a\n2. b", "end"]


def test_tiny_chunks_fold_into_the_one_before():
    out = M.chunk_text("# A\n" + "word " * 80 + "\n# B\nx", "d")
    assert len(out) == 1 and out[0].text.endswith("# B\nx")
    assert len(M.chunk_text("# A\nx", "d")) == 1 and M.chunk_text("  ", "d") == []


FRONT = "---\ndoc_id: d1\ntitle: T\ndomain: Stats\nsource_type: Guide\nlanguage: EN\nversion: 2\ntags: [b, ' a ', b, '', 3]\n---\n# T\n"


def test_front_matter(spark):
    df = spark.createDataFrame([("a", FRONT), ("b", "# Only\n"), ("c", None), ("d", "---\n- x\n---\n"), ("e", "---\na: [\n---\n"), ("f", "---\nx")], "path string, text string")
    got = {r.path: r for r in M.parse_front_matter(df).collect()}
    assert got["a"].tags == ["b", "a"] and got["a"].all_tags == ["a", "b", "domain:stats", "lang:en", "source_type:guide", "version:2"]
    assert got["b"].title == "Only" and [got[k].front_state for k in "bcdef"] == ["missing", "missing", "not_mapping", "invalid", "unclosed"]


def codes(text):
    return {c for _, c, _ in M.issues(text)}


def test_validation_codes():
    assert codes("") == codes(None) == {"empty_file"} and M.issues("x", False)[0][1] == "encoding_error"
    assert {"min_content", "frontmatter_missing", "missing_title"} <= codes("short")
    found = codes(FRONT)
    assert {"frontmatter_tag_whitespace", "frontmatter_tag_duplicate", "frontmatter_tag_empty", "frontmatter_tag_not_string"} <= found and "frontmatter_missing_doc_id" not in found
    assert {"frontmatter_scope_violation", "frontmatter_missing_doc_id", "frontmatter_missing_title", "frontmatter_tags_not_list"} <= codes("---\ndataset: x\ntags: y\n---\n# T\n")
    assert ("WARN", "heading_hierarchy_skip", 2) in M.issues("# A\n### B\n") and "heading_hierarchy_skip" not in codes("# A\n  ### B\n")
    assert {"section_too_long", "long_line"} <= codes("# A\n" + "x" * 7000) and "estimated_chunks_high" in codes("# A\n" + "word\n" * 140000)
    table = "# A\n" + "| a |\n|---|\n" + "| 1 |\n" * 200
    assert "large_table" in codes(table) and "large_table" not in codes("# A\n|---|\n" + "| 1 |\n" * 200)


def test_blocking(spark):
    good = FRONT.replace(", 3]", "]")
    df = spark.createDataFrame([("a", good.replace("doc_id: d1\n", "")), ("b", good)], "path string, text string")
    report = M.validate(df)
    assert [r.path for r in M.blocked(report).collect()] == ["a"]
    assert {r.path for r in M.blocked(report, strict=True).collect()} == {"a", "b"}


def test_chunk_rows_and_inspection(spark):
    df = spark.createDataFrame([("d", DOC), ("e", None), ("f", " ")], "doc_id string, text string")
    rows = M.chunk_documents(df).collect()
    assert {r.doc_id for r in rows} == {"d"} and all(len(r.chunk_id) == 16 for r in rows)
    seen = {r.doc_id: r for r in M.inspect(df).collect()}
    assert (seen["d"].n_headings, seen["d"].n_tables) == (5, 1) and seen["e"].n_headings == 0


def test_registered_report_is_whole(spark, tmp_path):
    from quillon.plans import registry

    body = "word " * 60
    front = FRONT.replace("tags: [b, ' a ', b, '', 3]\n", "")
    texts = {
        1: None, 2: "short", 3: f"# T\n### Deep\n{body}", 4: f"{front}{body}", 5: f"{front}" + "x" * 7000, 6: f"---\nx\n{body}",
        7: f"{front}{body}\n| a |\n|---|\n" + "| 1 |\n" * 201, 8: f"---\na: [\n---\n# T\n{body}", 9: f"---\n- x\n---\n# T\n{body}",
    }
    want = {
        ("1", "ERROR", "empty_file", None), ("2", "WARN", "min_content", None), ("2", "WARN", "frontmatter_missing", None), ("2", "WARN", "missing_title", None),
        ("3", "WARN", "frontmatter_missing", None), ("3", "WARN", "heading_hierarchy_skip", 2), ("5", "WARN", "section_too_long", 9), ("5", "INFO", "long_line", 10),
        ("6", "WARN", "frontmatter_unclosed", 1), ("6", "WARN", "missing_title", None), ("7", "WARN", "large_table", 11), ("8", "ERROR", "frontmatter_invalid_yaml", 1), ("9", "ERROR", "frontmatter_not_mapping", 1),
    }
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.QUERIES["validate_documents"](spark, str(tmp_path)).select("path", "severity", "code", "line_number").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
