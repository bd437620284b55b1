"""Alignment, fill-in-middle and token counts against their definitions."""

import collections
import hashlib
import os
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusward.llm import alignment, infill, token_counts
from corpusward.llm.fertility import TOKENIZERS

from .test_llm import AWKWARD, make_docs

pytestmark = pytest.mark.skipif(not os.path.isdir(TOKENIZERS), reason="vocabularies are not there")
PARTS = ["word", "the", " ", "  ", "\n", "\n\n", "\t", "\r\n", "é", "ß", "漢字", "　", "\xa0", "\x1c", "\x85", "\x0b", "don't", "'s", "!!", "1234", "<|endoftext|>", "<s>", "</s>", "<unk>", "😀", "Ａ", "x" * 40, "9a" * 30, "\x00", "<", "|>"]


def mixed(rng, n, parts=PARTS):
    return "".join(rng.choice(parts) for _ in range(n))


@pytest.fixture(scope="module")
def byte_model():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")


# token counts


def rows_of(df):
    return collections.Counter(tuple(r) for r in df.collect())


def test_counts_equal_the_library(spark, byte_model):
    rng = random.Random(1)
    texts = [mixed(rng, rng.randrange(1, 120)) for _ in range(300)] + ["y" * 3000, "z" * 700 + " a" * 200, "<|endoftext|>" * 90, " " * 900, "\n" * 500 + "a"]
    rows = [*AWKWARD, *enumerate(texts, 100), (100, texts[0]), (390, "<|endoftext|> x" * 60), (390, "<|endoftext|> x" * 60)]
    want = collections.Counter()
    for r in rows:
        n = len(byte_model.encode(r[1] or "", add_special_tokens=False).ids)
        want[(r[0], len((r[1] or "").encode()), n, n > 512)] += 1
    docs = make_docs(spark, rows)
    for size, overlap in ((64, 8), (200, 20), (1 << 15, 256)):
        got = token_counts.count_tokens(docs, size=size, overlap=overlap)
        assert rows_of(got.drop("n_chunks")) == want, (size, overlap)
        assert size > 200 or got.agg(F.max("n_chunks")).first()[0] > 5
    assert token_counts.count_tokens(docs.where("false")).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=40), st.integers(0, 200), st.integers(0, 200))
def test_splices_are_right_wherever_chunks_meet(parts, at, overlap):
    """Tokens up to a shared boundary, by the chunk that began before, and from there on, by the next, are the text's."""
    text = "".join(parts)
    counter = token_counts._counter(f"{TOKENIZERS}/byte_bpe_50k.json")
    whole = counter.learn([text])[text] if text else 0
    left, right = text[: at + overlap], text[at:]
    n_right, begun, _ = token_counts.boundaries(right, at, overlap, len(text), counter)
    _, _, ended = token_counts.boundaries(left, 0, overlap, at, counter)
    before, after = ({m["at"]: m["before"] for m in x} for x in (ended, begun))
    for place in before.keys() & after.keys():
        assert before[place] + n_right - after[place] == whole


# fill-in-middle


def cut_by_hand(doc_id, text, seed=7, percent=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(units)
    if text == "" or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= percent:
        return (doc_id, n, "plain", text, None, None)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    form = "spm" if h4 % 100 < spm else "psm"
    output = f"<S>{suffix}<P>{prefix}<M>{middle}" if form == "spm" else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return (doc_id, n, form, output, len(prefix), len(middle))


def test_infill_equals_a_cut_by_hand(spark):
    rng = random.Random(2)
    parts = ["a", "é😀", "\n", "\n\n", "\r", "$1", "\\", "<P", ">", "<", "S>", "\x00", " ", "line of text"]
    rows = [*AWKWARD, *[(k, mixed(rng, rng.randrange(40), parts)) for k in range(100, 500)], (600, "x<M>y\n"), (601, "\n"), (602, "a\nb\n" * 150_000), (603, "c" * 2_000_000 + "\n" + "d" * 2_000_000)]
    docs = make_docs(spark, rows)
    made = infill.infill(docs)
    assert rows_of(made) == collections.Counter(cut_by_hand(r[0], r[1]) for r in rows)
    back = made.withColumn("back", infill.restored(F.col("output"), F.col("form"))).join(spark.createDataFrame([r for r in rows if r[0] is not None and r[0] >= 100], "doc_id long, t string"), "doc_id")
    assert back.where("back <> t").count() == 0 and back.count() == len([r for r in rows if (r[0] or 0) >= 100])
    some = infill.infill(docs, seed=3, percent=40, spm_percent=20)
    assert rows_of(some) == collections.Counter(cut_by_hand(r[0], r[1], 3, 40, 20) for r in rows)
    digests = infill.infill_digests(docs).where("doc_id >= 100").join(spark.createDataFrame(rows, "doc_id long, t string"), "doc_id")
    assert digests.where("restored_sha256 <> sha2(t, 256)").count() == 0
    assert infill.infill(docs.where("false")).count() == 0


def test_infill_marks_must_not_overlap(spark):
    docs = make_docs(spark, [(1, "a\nb\n")])
    for marks in (("ab", "bc", "x"), ("aba", "x", "y"), ("a", "a", "b"), ("", "a", "b"), ("abc", "b", "x")):
        with pytest.raises(ValueError):
            infill.infill(docs, marks=marks)
    row = infill.infill(docs, marks=("$p\\", "%s*", "(m")).first()
    assert all(m in row.output for m in ("$p\\", "%s*", "(m")) and len(row.output) == 4 + 8


# alignment


def aligned_by_hand(texts, byte_model):
    """By the definition: whole texts, every pair of occurrences, counts over all rows."""
    import sentencepiece

    pieces = sentencepiece.SentencePieceProcessor(model_file=f"{TOKENIZERS}/piece_bpe_32k.model")
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in printable)}
    byte_model.encode_special_tokens = True
    links, out = [], []
    for text in texts:
        found = []
        if text:
            a = byte_model.encode(f" {text}", add_special_tokens=False)
            b = pieces.encode(text)
            ranges = []
            for ids, raw in (
                (a.ids, [bytes(byte_of[c] for c in t) for t in a.tokens]),
                (b, [bytes([int(p[3:5], 16)]) if pieces.IsByte(i) else p.replace("▁", " ").encode() for i, p in zip(b, map(pieces.IdToPiece, b))]),
            ):
                ends = [sum(map(len, raw[: k + 1])) for k in range(len(raw))]
                ranges.append([(i, e - len(r), e) for i, r, e in zip(ids, raw, ends)])
                found.append(b"".join(raw) == f" {text}".encode())
            found = ranges if all(found) else []
        links.append([(x[0], y[0]) for x in found[0] for y in found[1] if x[1] < y[2] and y[1] < x[2]] if found else [])
        if not found:
            out.append((0, 0, 0, ""))
            continue
        a, b = found
        shown, ends = [], sorted({x[2] for x in a} & {y[2] for y in b})
        for low, high in zip([0, *ends], ends):
            shown.append("|".join(",".join(str(x[0]) for x in side if low < x[2] <= high) for side in found))
        out.append((len(a), len(b), len(ends), hashlib.sha256(";".join(shown).encode()).hexdigest()))
    byte_model.encode_special_tokens = False
    count = collections.Counter(p for one in links for p in set(one))
    most = collections.defaultdict(int)
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    return [(*o[:3], len(one), sum(count[p] == most[p[0]] for p in one), sum(count[p] for p in one), o[3]) for o, one in zip(out, links)]


def test_alignment_equals_the_definition(spark, byte_model):
    rng = random.Random(3)
    parts = [*PARTS, "▁", *["some", " words", " and", " more", "\nlines", " übung", " licence,"] * 6]
    texts = [mixed(rng, rng.randrange(1, 60), parts if rng.random() < 0.3 else parts[len(PARTS) + 1 :]) for _ in range(150)] + ["q" * 900, " ", "\n", "a ", " \n \n"]
    rows = [(d, t and t[:600]) for d, t in AWKWARD] + [*enumerate(texts, 100), (100, texts[0])]
    want = collections.Counter((r[0], *w) for r, w in zip(rows, aligned_by_hand([r[1] for r in rows], byte_model)))
    docs = make_docs(spark, rows)
    for size, pairs in ((5, 0), (37, 10**6), (1 << 15, 10**6)):
        assert rows_of(alignment.align(docs, size=size, broadcast_pairs=pairs)) == want, size
    assert alignment.align(docs.where("false")).count() == 0


def same(a, b):
    return (a.head, a.tail, a.closed is None) == (b.head, b.tail, b.closed is None) and (
        a.closed is None or (a.closed.figures.tolist(), ";".join(filter(None, a.closed.shown)), a.closed.pairs.tolist(), a.closed.times.tolist(), a.closed.same)
        == (b.closed.figures.tolist(), ";".join(filter(None, b.closed.shown)), b.closed.pairs.tolist(), b.closed.times.tolist(), b.closed.same)
    )


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(PARTS), min_size=1, max_size=40), st.lists(st.integers(0, 300), min_size=2, max_size=5))
def test_fragments_compose_in_any_order(parts, cuts):
    """Any cuts, composed from the left, from the right or at once, give the fragment of the whole."""
    text = " " + "".join(parts)
    aligner = alignment._aligner(TOKENIZERS)
    at = [0, *sorted(min(c, len(text)) for c in cuts), len(text)]
    pieces = alignment.fragments([text[x:y] for x, y in zip(at, at[1:])], aligner)
    ((whole),) = alignment.fragments([text], aligner)
    left, right = pieces[0], pieces[-1]
    for p in pieces[1:]:
        left = alignment.compose([left, p], aligner)
    for p in reversed(pieces[:-1]):
        right = alignment.compose([p, right], aligner)
    assert same(left, whole) and same(right, whole) and same(alignment.compose(pieces, aligner), whole)


def test_plain_units_have_the_librarys_tokens(byte_model):
    """Plain units are encoded by ranks: as the library does, for every plain character beside every kind of neighbour."""
    aligner = alignment._aligner(TOKENIZERS)
    chars = [chr(c) for c in [9, 10, 13, *range(32, 127), *range(0xA0, 0x250)]]
    units = [u for c in chars for u in (f" {c}a", f" a{c}", f" 1{c}1", f" !{c}'", f" {c}{c}s", f"\n{c}x") if alignment._PLAIN(u)]
    tokens, sizes = aligner._of_a(units)
    byte_model.encode_special_tokens = True
    want = [byte_model.encode(u, add_special_tokens=False).ids for u in units]
    byte_model.encode_special_tokens = False
    assert len(units) > 3000 and sizes.tolist() == list(map(len, want)) and tokens.tolist() == [i for one in want for i in one]
