"""Splitting, encoding, documentation pairs, languages: pure functions against brute force, and edge cases in Spark."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codelode.llm import docpairs, language, splitting, tokens

# ---------------------------------------------------------------- splitting


def brute_best(values, low, high):
    return max(range(low, high + 1), key=lambda i: (values[i], i))


def brute_pieces(text, limit, overlap):
    values = splitting.strengths(splitting._codes(text)).tolist()
    values[-1] = splitting.LINE_END
    out, start, done, line = [], 0, 0, splitting.LINE_END
    while len(text) - start > limit:
        cut = brute_best(values, max(start + limit // 2, done + 1), start + limit)
        ends = [i for i in range(max(done, start) + 1, start + limit + 1) if values[i] >= line]
        if values[cut] < line and ends:
            cut = max(ends, key=lambda i: (values[i], i))
        out.append((start, cut))
        least = max(cut - overlap, start + 1)
        back = brute_best(values, least, cut - 1) if least < cut else cut
        back = least if least < cut and values[back] <= splitting.NONE else back
        ends = [i for i in range(cut + 1, min(cut + limit, len(text)) + 1) if values[i] >= line]
        if ends and least < cut and ends[0] > back + limit:
            least = max(ends[0] - limit, least)
            back = brute_best(values, least, cut)
            back = least if values[back] <= splitting.NONE else back
        start, done = back, cut
    return [*out, (start, len(text))] if text else []


@settings(deadline=None, max_examples=150)
@given(st.text(alphabet="ab \n\r;.{}é字\u0301", max_size=600), st.integers(20, 60))
def test_pieces_match_brute_force(text, limit):
    assert splitting.pieces(text, limit, limit // 5) == brute_pieces(text, limit, limit // 5)


@settings(deadline=None, max_examples=300)
@given(st.lists(st.sampled_from(["a", "b c", "\n", "\r\n", "\n\n", "    ", "x" * 18, "y" * 20, "e\u0301", "\u200d", ";", "}\n"]), max_size=80), st.integers(0, 9), st.sampled_from([1, 100, 1 << 16]))
def test_lines_that_fit_are_never_cut(parts, overlap, block):
    text = "".join(parts)
    found = splitting.pieces(text, 20, overlap, block)
    fits = all(len(x) - x.endswith("\r") <= 20 for x in text.split("\n"))
    if len(text) > 20:
        assert all(splitting.at_line_end(text, end) for _, end in found) == fits
        assert found[0][0] == 0 and found[-1][1] == len(text)
    for (a, b), (c, d) in zip(found, found[1:]):
        assert a < c <= b < d and b - c <= overlap and 0 < b - a <= 20


def test_steps_back_to_the_right():
    text = ("x" * 30 + "\n") * 200
    assert all(b - c == 31 for (_, b), (c, _) in zip(splitting.pieces(text), splitting.pieces(text)[1:]))


def test_pieces_cover_and_overlap():
    text = "def f():\r\n    return 1\r\n\r\n" * 500
    found = splitting.pieces(text)
    assert found[0][0] == 0 and found[-1][1] == len(text)
    for (a, b), (c, d) in zip(found, found[1:]):
        assert a < c <= b < d and b - c <= 100 and b - a <= 800
        assert text[b - 1] == "\n" and text[c - 1] == "\n"  # line ends are natural boundaries
    assert splitting.pieces(text, block=splitting.BLOCK * 4) == found


def test_pieces_without_boundary():
    found = splitting.pieces("x" * 2000)
    assert [b - a for a, b in found[:-1]] == [800] * (len(found) - 1)
    assert all(b - c == 100 for (_, b), (c, _) in zip(found, found[1:]))


def test_range_max_prefers_right():
    import numpy as np

    values = np.array([1, 5, 2, 5, 0, 3], dtype=np.int8)
    table = splitting.RangeMax(values)
    assert all(table.best(a, b) == brute_best(values, a, b) for a in range(6) for b in range(a, 6))


def test_split_edge_cases(spark, clashing):
    rows = [("a", None, 1), ("b", "", 1), ("c", "x" * 800, 1), ("d", "line\n" * 300, 10), ("d", "line\n" * 300, 10), ("e", "y" * 5000, None), (None, "z" * 900, 1)]
    frame = clashing(spark.createDataFrame(rows, "chunk_id string, raw_content string, start_line int"))
    out = splitting.split(frame).collect()
    assert {r.chunk_id for r in out} == {"d", "e", None}
    d = sorted((r for r in out if r.chunk_id == "d"), key=lambda r: r.piece_no)
    assert [r.cut for r in d] == ["line"] * len(d) and d[0].start_line == 10 and d[-1].end_line == 309
    text = "line\n" * 300
    assert all(r.piece == text[r.start_char : r.end_char] and r.start_line == 10 + text.count("\n", 0, r.start_char) for r in d)
    assert all(r.start_line is None and r.cut == "inside" for r in out if r.chunk_id == "e")
    assert splitting.split(frame.limit(0)).count() == 0


# ---------------------------------------------------------------- encoding

OWN = tokens.encoder()


def by_tree(text, size):
    parts = [tokens.words(text[i : i + size], i, OWN) for i in range(0, len(text), size)]
    return tokens.tree(text, 0, parts, OWN)[3].tolist() if parts else []


@settings(deadline=None, max_examples=150)
@given(st.lists(st.sampled_from(["a", "aa", "'", "ll", "'s", "'re", " ", "  ", "\n", "\r\n", "1", "42", "é", "の", "🙂", "-", "==", "the", "tion", "　", "<|endoftext|>"]), max_size=60), st.integers(1, 7))
def test_tree_is_exact(parts, size):
    text = "".join(parts)
    assert by_tree(text, size) == OWN.encode_ordinary(text)


@pytest.mark.parametrize("unit", ["a", "ab", "aab", "the", "=-", "🙂", "zq"])
def test_tree_joins_long_words(unit):
    text = unit * 3000
    assert by_tree(text, 700) == OWN.encode_ordinary(text)


def test_ids_decode_to_the_text(spark, clashing):
    long = "".join(random.Random(1).choice(["word ", "  ", "x" * 50, "\n", "é日本"]) for _ in range(6000))
    rows = [(1, None), (2, ""), (3, "   "), (4, "<|endoftext|> a"), (5, long), (5, long), (6, "a" * 40_000), (None, "b")]
    frame = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    out = tokens.encode_corpus(frame).collect()
    assert len(out) == len(rows)
    texts = dict(rows)
    for r in out:
        assert r.ids == tokens.encode(texts[r.doc_id]) and OWN.decode(r.ids) == (texts[r.doc_id] or "")
    assert tokens.encode_corpus(frame.limit(0)).count() == 0


def test_one_text_of_twenty_megabytes(spark):
    rng = random.Random(2)
    text = "".join(rng.choice(["word ", "some", "  ", "\n", "é日本 ", "x" * 9, "'ll "]) for _ in range(4_600_000))
    text += "a" * 200_000 + " " * 50_000 + text[:1_000_000]  # a word and a blank run longer than many pieces
    assert len(text.encode()) > 20_000_000
    out = tokens.encode_corpus(spark.createDataFrame([(1, text), (2, "b")], "doc_id long, text string")).collect()
    ids = {r.doc_id: r.ids for r in out}
    assert ids[1] == OWN.encode_ordinary(text) and ids[2] == OWN.encode_ordinary("b")


def test_same_ids_as_the_other_library():
    tokenizers = pytest.importorskip("tokenizers")
    other = tokenizers.Tokenizer.from_file(tokens.TOKENIZERS + "/byte_bpe_50k.json")
    other.encode_special_tokens = True
    for text in ["def f(x):\n    return x  # ok", "I'll don't", "日本語 ﬁ é é", "\x00\x1c\x85  x", "<|endoftext|>"]:
        assert tokens.encode(text) == other.encode(text, add_special_tokens=False).ids


# ---------------------------------------------------------------- documentation pairs

PROSE = [
    ("Closes every open lease that the last run left behind.", "close_lease"),
    ("@param rows\n@returns what remains after the filter", "f"),
    ("/** Wird erst geladen, wenn die Tabelle leer ist. */", "load"),
    ("// 記号表が揃うまで読み込まれません。", "load"),
    ("TODO: rename.\nRaises an error if the batch was cut off.", "prune"),
    (":param x: rows to look at, newest first\n:return:", "f"),
]
EMPTY = [
    "", None, "   ", "-", "...", "N/A", "null", "TODO", "todo: add docs.", "FIXME", "WIP", "tbd", "See above.", "Description.", "Method description goes here.", "Missing documentation",
    "Auto-generated method stub", "{@inheritDoc}", "@param x\n@returns", ":type x: str\n:rtype: list", "@param {string} x\n@returns {void}\n@private", "@author unknown", "@since 1.4",
    "eslint-disable-next-line no-shadow", "noqa: E501", "type: ignore", "nolint", "@ts-ignore", "lint:ignore U1000", "pylint: disable=unused-argument", "last modified: 04/2025", "Created 2024-01-13", "Author: bepa",
    "####################", "~~~~~~ function ~~~~~~", "if (x != null) { x.close(); }", "return token.trim(9);", "graph = load_graph(x)", "Prune edge.", "Prunes the edge", "prune_edge", "PruneEdge function.", "Prunes its edges.",
]


@pytest.mark.parametrize("doc,name", PROSE)
def test_prose(doc, name):
    assert docpairs.prose(doc, name)


@pytest.mark.parametrize("doc", EMPTY)
def test_no_prose(doc):
    assert docpairs.prose(doc, "prune_edge") == ""


CAPTURES = [
    ("typescript", "/** Says what it does. */\nexport async function go(a: string): Promise<void> {\n  const s = '}';  // }\n  if (a) { return `${a}}`; }\n}\nfunction other() {}", "go", 1, "Says what it does."),
    ("go", "// Sends all of it.\n//\n// Twice.\nfunc (s *Store) Send(x []Row) error {\n    return nil\n}", "Send", 3, "Twice."),
    ("rust", "/// Keeps it.\n#[inline]\npub fn keep(x: &'a str) -> Option<Row> {\n    Some(x)\n}", "keep", 2, "Keeps it."),
    ("java", "    /**\n     * Counts.\n     */\n    @Override\n    public int count(List<Row> a) {\n        return 1;\n    }", "count", 4, "Counts."),
    ("python", "@cached\ndef f(a, b=')'):\n    \"\"\"Reads it.\n\n    More.\n    \"\"\"\n    return '# no'\n\ndef g():\n    pass", "f", 1, "Reads it."),
    ("python", "# Above it.\ndef f(a):\n    return 1", "f", 1, "Above it."),
]


@pytest.mark.parametrize("lang,text,name,line,said", CAPTURES)
def test_capture(lang, text, name, line, said):
    doc, code = docpairs.capture(text, name, lang, line)
    assert said in doc and name in code and "other" not in code and "def g" not in code


def test_comment_is_whole_whether_the_pattern_fits_or_not():
    above = "/* Says it\n   in lines without a star.\n*/\n"
    for text in ("function f(a) {\n}", "const f = (a) => {\n};", "function f(a) {\n  never closed"):
        doc, code = docpairs.capture(above + text, "f", "typescript", 3)
        assert "in lines" in doc and text.split("\n")[0] in code
    assert docpairs.capture("def f(a) -> {}:\n    'Kept in one line.'", "f", "python", 0)[0] == "'Kept in one line.'"
    assert docpairs.capture("// A.\nfunction f(\n  a,\n  b\n) {\n}", "f", "typescript", 2)[0] == "// A."


def test_long_definitions_need_no_clock():
    body = "if (x) { y('}'); }\n" * 4000
    doc, code = docpairs.capture("/** Long. */\nfunction f(a) {\n" + body + "}\nfunction g() {}", "f", "typescript", 1)
    assert "Long" in doc and code.endswith("}\n}") and "g()" not in code
    assert "Open" in docpairs.capture("// Open.\nfunction f(a) {\n" + "if (x) {\n" * 4000, "f", "typescript", 1)[0]


def test_capture_needs_attachment():
    assert docpairs.capture("// Far away.\n\nfunction f() {\n}", "f", "javascript", 2)[0] == ""
    doc, code = docpairs.capture("// Near.\nfunction f() {\n  never closed", "f", "javascript", 1)
    assert "Near" in doc and "never closed" in code


def test_pairs_in_spark(spark, clashing):
    sym = "symbol_id string, repo_id string, file_path string, name string, kind string, line_number int, docstring string, parent_symbol string, indexed_at timestamp_ntz"
    import datetime as dt

    t0, t1 = dt.datetime(2025, 1, 1), dt.datetime(2025, 2, 1)
    symbols = [
        ("s1", "r", "f.py", "load", "function", 3, None, None, t0), ("s1", "r", "f.py", "load", "function", 3, None, None, t0),
        ("s2", "r", "f.py", "go", "method", 12, "TODO", "Cls", t0), ("s2", "r", "f.py", "go", "method", 12, "Drops every row that is older than a day.", "Cls", t1),
        ("s3", "r", "f.py", "Cls", "class", 10, "A class that is documented very well.", None, t0), ("s4", "r", "f.py", "gone", "function", 90, "Has no chunk although it is documented.", None, t0),
        (None, "r", "f.py", "load", "function", 3, "Documented but without an id at all.", None, t0), ("s5", "r", "f.py", None, None, None, None, None, None),
    ]
    chunk = "chunk_id string, repo_id string, file_path string, symbol_name string, language string, start_line int, raw_content string"
    load = "def load(x):\n    \"\"\"Reads what the last run has left on disk.\"\"\"\n    return x"
    chunks = [("c1", "r", "f.py", "load", "python", 3, load), ("c1", "r", "f.py", "load", "python", 3, load), ("c2", "r", "f.py", "Cls.go", "python", 12, "    def go(self):\n        pass"), ("c3", "r", "f.py", None, None, None, None), ("c4", "r", "f.py", "gone", "python", 1, None)]
    s, c = clashing(spark.createDataFrame(symbols, sym)), clashing(spark.createDataFrame(chunks, chunk))
    out = {r.symbol_id: r for r in docpairs.pairs(s, c).collect()}
    assert set(out) == {"s1", "s2"}
    assert out["s1"].code == load and "last run" in out["s1"].description and out["s2"].description.startswith("Drops")
    assert docpairs.pairs(s.limit(0), c).count() == docpairs.pairs(s, c.limit(0)).count() == 0


# ---------------------------------------------------------------- languages


def test_sentences_leave_out_code():
    text = "# A heading that is no sentence\n\nPlease check `load_graph` before the merge (https://a.invalid/x).\n```\nfor x in y: load(x)\n```\n[12:31:23.569] 0xb93d2959 sync:622 rc=5\n- Das Protokoll ist leer. / The log is empty again today.\nx = load(y, 2)\n"
    found = [w.strip() for _, _, w in language.sentences(text)]
    assert found == ["please check before the merge", "das protokoll ist leer", "the log is empty again today"]
    for start, end, _ in language.sentences(text):
        assert text[start:end].strip()


def test_normalize_forgets_accents_and_case():
    assert language.normalize("ÉTÉ") == language.normalize("été") == " ete "


def test_ngram_scores_match_brute_force():
    import numpy as np

    logs = np.random.default_rng(0).normal(size=(language.BUCKETS, 3)).astype(np.float32)
    texts = [" one two ", "", " drei ", " 日本 "]
    whole = language.score(texts, logs)
    for i, t in enumerate(texts):
        buckets = np.concatenate([b for b, _ in language.ngrams([t])])
        assert len(buckets) == sum(max(0, len(t) - n + 1) for n in language.SIZES)
        assert np.allclose(whole[i], logs[buckets].sum(axis=0), atol=1e-3)


def test_coverage_counts_what_has_no_language(spark):
    samples = spark.read.parquet("/root/testdata/sf0.01/lang_samples.parquet")
    en = "The search endpoint fails when the chunk cache is empty, although the log claims otherwise."
    docs = spark.createDataFrame([(1, "en", en), (2, None, None), (3, "en", " "), (4, "en", "Too short."), (5, "en", "x = load(y, 2);")], "doc_id long, lang string, text string")
    out = {r.state: r.docs for r in language.coverage(docs, language.segments(docs, samples)).collect()}
    assert out == {"one language": 1, "no text": 2, "no sentence": 2}


def test_held_out_accuracy(spark):
    """Fitted on half of the samples, the other half is told."""
    import pandas as pd

    rows = spark.read.parquet("/root/testdata/sf0.01/lang_samples.parquet").toPandas().sort_values("sample_id")
    half = rows.groupby("lang").cumcount() % 2 == 0
    langs, logs = language.matrix(pd.concat(list(language._count_samples([rows[half]]))))
    odds = language.score([language.normalize(language._NOISE.sub(" ", t)) for t in rows[~half].text], logs)
    told = [langs[i] for i in odds.argmax(axis=1)]
    assert sum(a == b for a, b in zip(told, rows[~half].lang)) >= 0.95 * len(told)


def test_wrong_labels(spark, clashing):
    samples = spark.read.parquet("/root/testdata/sf0.01/lang_samples.parquet")
    en, de = "The search endpoint fails when the chunk cache is empty, although the log claims otherwise.", "Der Fehler tritt nur auf, wenn die Warteschlange leer ist, aber das merkt man kaum."
    rows = [
        (1, "en", en), (2, "English", en), (3, "en_GB", en), (4, None, en), (5, "  ", en), (6, "de", en), (7, "mul", en + "\n" + de), (8, "en", None), (9, None, ""), (10, None, "x = 1;\n"), (6, "de", en),
        (None, "de", en), (11, "de", de.upper()), (12, "ger", de), (13, "en", (en + "\n") * 3000),
    ]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, lang string, text string"))
    out = {(r.doc_id, r.lang) for r in language.wrong_labels(docs, clashing(samples)).collect()}
    assert out == {(4, "en"), (5, "en"), (6, "en"), (7, "de"), (7, "en"), (None, "en")}
    assert language.wrong_labels(docs.limit(0), samples).count() == 0
    with pytest.raises(ValueError):
        language.fit(samples.limit(0), docs)
