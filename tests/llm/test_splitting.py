import random

import pytest
from tokenizers import Tokenizer

from tidewell.llm.bpe import TOKENIZERS, VOCABULARY, CorpusEncoder
from tidewell.llm.splitting import LEVELS, MARK, WORD, Splitter, boundaries, split_documents, weak_boundaries

PATH = f"{TOKENIZERS}/{VOCABULARY}"


@pytest.fixture(scope="module")
def count():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda text: len(t.encode(text, add_special_tokens=False).ids)


def prose(seed, n):
    rng = random.Random(seed)
    words = "the cache driver won't compile; naïve Überlauf 日本 0x1F 3.14 (see docs) foo_bar() e.g. maybe".split()
    parts = []
    for k in range(n):
        sentence = " ".join(rng.choice(words) for _ in range(rng.randint(3, 15))).capitalize() + rng.choice([". ", "! ", "? "])
        parts.append(sentence)
        if rng.random() < 0.15:
            parts.append("\n\n")
        if rng.random() < 0.03:
            parts.append(f"\n\n## Part {k}\n\n")
        if rng.random() < 0.04:
            parts.append("\n```py\n" + "".join(f"x_{j} = call({j})\n\n" for j in range(rng.randint(2, 40))) + "```\n")
    return "".join(parts)


TEXTS = [prose(1, 30), prose(2, 200), prose(3, 900), "a" * 20_000, " " * 9_000, "中" * 5_000, "😀" * 3_000, "x y " * 4_000, "\n" * 5_000, "{" + ",".join(f'"k{j}":{j * 7919}' for j in range(900)) + "}", "<p>word</p>" * 800, "\r\n".join(["line"] * 3_000), "é́" * 2_000]


@pytest.mark.parametrize("limit,overlap", [(512, 32), (64, 8), (40, 0), (9, 3)])
def test_pieces(count, limit, overlap):
    encoder = CorpusEncoder(PATH)
    splitter = Splitter(encoder, limit, overlap)
    for text, words in zip(TEXTS, encoder.words(TEXTS), strict=True):
        if limit < 64 and len(text) > 6_000:
            continue
        ids = encoder.gather(words)
        pieces = splitter.split(text, ids)
        assert "".join(text[body:end] for _, body, end, *_ in pieces) == text
        for k, (start, body, end, n, repeated, _) in enumerate(pieces):
            assert count(text[start:end]) == n <= limit and end > body
            assert count(text[start:body]) == repeated <= overlap and (k or start == body == 0)
            if k:
                assert start >= pieces[k - 1][0]
                longer = [count(text[s:body]) for s in range(max(pieces[k - 1][0], start - 12), start)]
                assert repeated == overlap or overlap not in longer
        assert len(pieces) == 1 if len(ids) <= limit else len(pieces) >= 1 + -(-(len(ids) - limit) // (limit - overlap))


def test_prose_is_never_cut_inside_a_word_and_mostly_at_strong_places():
    encoder = CorpusEncoder(PATH)
    text = prose(5, 900)
    pieces = Splitter(encoder).split(text, encoder.gather(encoder.words([text])[0]))
    kinds = [LEVELS[p[5]] for p in pieces[:-1]]
    assert not {"character", "mark", "word"} & set(kinds)
    assert sum(k in ("section", "paragraph", "code") for k in kinds) >= 0.6 * len(kinds)
    sizes = [p[3] for p in pieces]
    assert max(sizes) - min(sizes) <= 512 // 2  # balanced: no small rest at the end


def test_boundaries():
    text = "# A\nOne. Two!\n\nThree\n```\ncode. x\n\ny\n```\nend, of\n---\nz"
    found = {at: LEVELS[level] for at, level in boundaries(text).items()}
    assert found[text.index(" Two")] == "sentence" and found[text.index("Three")] == "paragraph" and found[text.index("```")] == "code"
    assert found[text.index("end,")] == "code" and found[text.index("---")] == "section" and found[text.index("y\n")] == "line"
    assert 0 not in found and len(text) not in found
    assert weak_boundaries(text, 1, len(text))[text.index(" x\n")] == WORD and set(weak_boundaries('{"a":1,"b":2}', 0, 12).values()) == {MARK}
    assert boundaries("") == {} and boundaries("word") == {}


def test_operator(spark, count):
    rows = [(1, prose(7, 300)), (2, "short"), (3, None), (4, ""), (5, "word " * 512), (6, "word " * 600), (7, prose(7, 300)), (7, prose(7, 300)), (None, "word " * 600)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS piece", "2 AS n_tokens").repartition(2)
    got = split_documents(frame).collect()
    assert {r["doc_id"] for r in got} == {1, 5, 6, 7, None} - ({5} if count("word " * 512) <= 512 else set())
    assert all(count(r["piece"]) == r["n_tokens"] <= 512 for r in got)
    by = sorted((r for r in got if r["doc_id"] == 1), key=lambda r: r["piece_no"])
    text = rows[0][1]
    assert [r["piece_no"] for r in by] == list(range(by[0]["n_pieces"])) and all(r["piece"] == text[r["start_char"] : r["end_char"]] for r in by)
    small = split_documents(frame, keep_small=True).where("doc_id IN (2, 3, 4)").collect()
    assert sorted((r["doc_id"], r["piece"], r["n_pieces"]) for r in small) == [(2, "short", 1), (4, "", 1)]
    assert split_documents(frame.limit(0)).count() == 0
    with pytest.raises(ValueError):
        Splitter(CorpusEncoder(PATH), 10, 5)


RULERS = [
    (ruler, lead, tail)
    for ruler in ("=" * 64, " " + "=" * 65, "-" * 64, "." * 64, "_" * 64)
    for lead in ("\n", "x", "")
    for tail in ("\nword" + " word" * n + "</p>" for n in range(24, 31))
]


def test_the_overlap_reaches_past_long_rulers(count):
    encoder = CorpusEncoder(PATH)
    splitter, found = Splitter(encoder), {}
    for ruler, lead, tail in RULERS:
        text = "word " * 20 + lead + ruler + tail + "</div>" + " word" * 600
        cut = text.index("</div>")
        splitter.split(text, encoder.gather(encoder.words([text])[0]))
        start, repeated = splitter._overlap(text, cut, 0)
        best = max(n for s in range(cut) if (n := count(text[s:cut])) <= 32)
        found[ruler, lead, tail] = (repeated, count(text[start:cut])) == (best, best)
    assert all(found.values()), [k for k, right in found.items() if not right]
    text = "word " * 2_000 + "\n" + "=" * 64 + "\nword" + " word" * 27 + "</p></div>"
    splitter.split(text, encoder.gather(encoder.words([text])[0]))
    start, repeated = splitter._overlap(text, text.index("</div>"), 0)
    assert repeated == count(text[start : text.index("</div>")]) == 32


def test_a_far_boundary_comes_before_a_cut_inside_a_word(count):
    encoder = CorpusEncoder(PATH)
    splitter, rng = Splitter(encoder), random.Random(3)
    run = "".join(rng.choice("0123456789abcdef") for _ in range(2_000))
    run = run[: max(n for n in range(0, 2_000, 5) if count(run[:n]) <= 400)]
    for lead, kind in (("word " * 199 + "word\n", "line"), ("word " * 199, "word"), ("word" * 199 + ",", "mark")):
        for text in (lead + run, lead + run + "\n" + "word " * 900):
            pieces = splitter.split(text, ids := encoder.gather(encoder.words([text])[0]))
            assert len(pieces) == 1 + -(-(len(ids) - 512) // 480)
            assert LEVELS[pieces[0][5]] == kind and "character" not in {LEVELS[p[5]] for p in pieces}
            assert all(count(text[start:end]) == n <= 512 for start, _, end, n, *_ in pieces)
            assert "".join(text[body:end] for _, body, end, *_ in pieces) == text
    # nothing natural: still cut between characters, in the fewest pieces
    assert {LEVELS[p[5]] for p in splitter.split(run * 3, encoder.gather(encoder.words([run * 3])[0]))[:-1]} == {"character"}
