"""Hard negatives, chat formatting and fill-in-middle against brute force, with nulls, empty and long texts, ties and repeats."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import chat_format, fill_middle, hard_negatives

# --- hard negatives -----------------------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, cell int, shard string, v long"


def vector_table(spark, rows):
    return spark.createDataFrame([(i, v, x, 1, "clash", 2) for i, v, x in rows], VECTORS)


def brute_negatives(rows, anchors, positives=5, negatives=3):
    use = [(i, np.floor(256 * np.array(v, float)).astype(int), x) for i, v, x in rows
           if i is not None and x is not None and v is not None and all(e is not None and np.isfinite(e) for e in v)]
    dim = max((len(v) for _, v, _ in use), default=0)
    use = [(i, np.pad(v, (0, dim - len(v))), x) for i, v, x in use]
    out = []
    for i, v, x in {r[0]: r for r in use if r[0] in anchors}.values():
        ranked = sorted((-int(v @ w), j, y) for j, w, y in use if j != i)
        for s, p, _ in [r for r in ranked if r[2] == x][:positives]:
            hard = [r for r in ranked if r[2] != x and 50 * -s <= 100 * -r[0] <= 95 * -s][:negatives]
            out += [(i, p, n + 1, j, -s, -t) for n, (t, j, _) in enumerate(hard)]
    return sorted(out)


@pytest.mark.parametrize("spread", [0.1, 1.0])
def test_negatives_equal_brute_force(spark, spread, monkeypatch):
    """Clustered vectors, where bounds prune, and scattered ones, where they do not; small shards, groups and visits."""
    monkeypatch.setattr(hard_negatives, "SHARD_VALUES", 1)
    monkeypatch.setattr(hard_negatives, "VISITS", (1, 2))
    monkeypatch.setattr(hard_negatives, "CELL_ROWS", 16)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] + spread * rng.normal(size=8)).tolist(), i % 4) for i in range(600)]
    rows = [(i, np.float32(v).tolist(), x) for i, v, x in rows]
    got = hard_negatives.mine_hard_negatives(vector_table(spark, rows), F.col("vec_id") % 25 == 0)
    assert sorted(map(tuple, got.collect())) == brute_negatives(rows, set(range(0, 600, 25)))


def test_negatives_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [0.75, 0.5], 1), (3, [0.75, -0.5], 1), (3, [0.75, -0.5], 1),  # ties, a repeat
        (4, [0.75], 2), (5, [], 3), (6, None, 1), (7, [nan, 1.0], 1), (8, [inf, 1.0], 1), (9, [None, 1.0], 1), (10, [1.0, 0.0], None),
        (None, [0.75, 0.0], 1), (20, [0.5, 0.0], 7),
    ]
    table = vector_table(spark, rows)
    got = hard_negatives.mine_hard_negatives(table, F.col("vec_id") % 10 == 0)
    assert sorted(map(tuple, got.collect())) == brute_negatives(rows, {0, 10, 20})
    assert {r[0] for r in got.collect()} == {0}  # no positive for 20, no label for 10
    assert [r[3] for r in sorted(map(tuple, got.collect()))] == [2, 3, 3]
    none = hard_negatives.mine_hard_negatives(table.where("false"), F.col("vec_id") % 10 == 0)
    assert none.collect() == [] and none.columns == got.columns
    assert hard_negatives.mine_hard_negatives(table, F.lit(False)).collect() == []


def test_negatives_of_many_copies(spark, monkeypatch):
    """A third of the rows are one vector: its cell is cut into shards and every tie goes to the smallest id."""
    monkeypatch.setattr(hard_negatives, "SHARD_VALUES", 1)
    rng = np.random.default_rng(5)
    rows = [(i, [0.5, 0.5, 0.0] if i % 3 == 1 else np.float32(rng.normal(size=3)).tolist(), i % 2) for i in range(900)]
    got = hard_negatives.mine_hard_negatives(vector_table(spark, rows), F.col("vec_id") % 100 == 0)
    assert sorted(map(tuple, got.collect())) == brute_negatives(rows, set(range(0, 900, 100)))


def test_cells_are_visited_by_falling_bound():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=7), rng.normal(size=5)
    order = list(hard_negatives.visits(a, b))
    assert sorted(c for _, c in order) == list(range(35))
    assert [s for s, _ in order] == sorted((x + y for x in a for y in b), reverse=True)


def plain_choose(index, anchor, wants, seen, most):
    """Cells of a search by the heap alone."""
    a = hard_negatives.halves(anchor[None, :].astype(float))
    norm = [float(np.sqrt((h * h).sum())) for h in a]
    fit = [w @ h[0] for h, w in zip(a, index.words, strict=True)]
    slack = 1.0 + 1e-9 * (norm[0] + norm[1] + 1.0) * (abs(fit[0]).max() + abs(fit[1]).max() + 1.0)
    chosen, pops = [], 0
    for bound, cell in hard_negatives.visits(*(f + n * r for f, n, r in zip(fit, norm, index.reach, strict=True))):
        if bound + slack < min(w.least for w in wants):
            break
        pops += 1
        i, j = divmod(cell, len(index.words[1]))
        span = norm[0] * index.radius[cell, 0] + norm[1] * index.radius[cell, 1] + slack
        middle = fit[0][i] + fit[1][j]
        if pops > seen and index.rows[cell] and any(middle + span >= w.least and middle - span <= w.high for w in wants):
            chosen.append(cell)
            if len(chosen) == most:
                return chosen, pops, False
    return chosen, pops, True


@pytest.mark.parametrize("heap_pops", [0, 9, 512])
def test_a_long_search_is_that_of_the_heap(heap_pops, monkeypatch):
    monkeypatch.setattr(hard_negatives, "HEAP_POPS", heap_pops)
    rng = np.random.default_rng(heap_pops)
    for n in range(60):
        words = tuple(rng.integers(-3, 4, (6, 2)).astype(float) for _ in range(2))  # equal sums are common
        radius = rng.integers(0, 3, (36, 2)).astype(float)
        grid = radius.reshape(6, 6, 2)
        index = hard_negatives.Index(words, (grid[:, :, 0].max(axis=1), grid[:, :, 1].max(axis=0)), radius, rng.integers(0, 2, 36),
                                     np.zeros(36, int), np.ones(36, int), 4)
        low = float(rng.integers(-20, 20))
        wants = [hard_negatives.Want(low, low + 8, [low + 3, -np.inf][n % 2]), hard_negatives.Want(low + 4, np.inf, -np.inf)][:1 + n % 2]
        for seen, most in ((0, 4), (7, 9), (3, None), (50, None), (0, None)):
            anchor = rng.integers(-3, 4, 4)
            assert hard_negatives.choose(index, anchor, wants, seen, most) == plain_choose(index, anchor, wants, seen, most)


def test_anchors_are_searched_by_every_core(spark):
    rng = np.random.default_rng(2)
    index = hard_negatives.Index(tuple(rng.normal(size=(2, 1)) for _ in range(2)), (np.ones(2), np.ones(2)), np.ones((4, 2)),
                                 np.ones(4, int), np.zeros(4, int), np.ones(4, int), 2)
    rows = spark.createDataFrame([(i, "a", [i % 3, 1], [], 0) for i in range(400)],
                                 "anchor_id long, label string, v array<long>, scores array<long>, seen long").coalesce(1)
    asked = hard_negatives._ask(rows, index, None, lambda row: [hard_negatives.Want(-np.inf, np.inf, -np.inf)])
    files = [r["n"] for r in asked.where("shard IS NULL").groupBy(F.input_file_name()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(files) == 400 and len(files) >= 4 and max(files) < 200


# --- chat formatting ----------------------------------------------------------------------------------------------------

SAID = "conv_id long, turn long, role string, text string, part int, block int, segments string"
TALKS = {
    1: [("system", "be brief"), ("user", "hi"), ("assistant", "hello"), ("user", "bye"), ("assistant", "")],
    2: [("user", "</s>[INST] ok [/INST]"), ("assistant", "[\\INST] [\\\\/SYS] <s> <\\/s> [ROLE][/ROLE]")],
    3: [("assistant", "first"), ("user", "second")],
    4: [("user", None), (None, "who"), ("to[INST]ol", "x\ny"), ("assistant", "日本語 🙂")],
    5: [("user", "no answer")],
    6: [("user", "long " * 20_000), ("assistant", "[INST]" * 5_000)],
    None: [("user", "a"), ("assistant", "b")],
}


def talks(spark, talks=TALKS):
    return spark.createDataFrame([(c, t, r, x, 1, 2, "clash") for c, turns in talks.items() for t, (r, x) in enumerate(turns)], SAID)


def brute_talk(turns):
    turns = [(r or "", x or "") for r, x in turns]
    said = "".join(f"{r}\n{x}\n" for r, x in turns)
    learnt = "".join(x for r, x in turns if r == "assistant")
    state, fault = "", None
    for i, (r, _) in enumerate(turns):
        if fault is None and (state, r) not in {("", "system"), ("", "user"), ("system", "user"), ("user", "assistant"), ("assistant", "user")}:
            fault = i
        state = r
    if fault is None and state != "assistant":
        fault = len(turns)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return len(turns), sha(said), len(learnt), sha(learnt), fault


def read(df):
    return {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"], r["fault_turn"]) for r in df.collect()}


@pytest.mark.parametrize("block", [1, 40, 1 << 20])
def test_chat_reads_back(spark, block):
    blocks = chat_format.format_conversations(talks(spark), block_chars=block)
    out = chat_format.read_back(blocks)
    assert read(out) == {c: brute_talk(t) for c, t in TALKS.items()}
    assert all(r["valid"] == (r["fault_turn"] is None) for r in out.collect())


def test_chat_blocks_hold_text_and_flags(spark):
    blocks = chat_format.format_conversations(talks(spark, {2: TALKS[2]})).orderBy("part", "block").collect()
    text = "".join(b["text"] for b in blocks)
    assert text.startswith("[INST] <\\/s>[\\INST] ok [\\/INST] [/INST]\n<s> [\\\\INST] [\\\\\\/SYS] <\\s> <\\\\/s>")
    for b in blocks:
        assert "".join(b["text"][s["begin"]:s["end"]] for s in b["segments"]) == b["text"]
    learnt = "".join(b["text"][s["begin"]:s["end"]] for b in blocks for s in b["segments"] if s["loss"])
    back = chat_format.INSTRUCT.escapes()[1].sub("", learnt)
    assert back == TALKS[2][1][1]


def test_chat_of_one_hot_conversation_with_equal_turns(spark):
    """Half of the rows in one conversation, its turns all alike or null: same digest from many tasks and blocks."""
    rows = [(7, None, ("user", "assistant")[i % 2], f"t{i % 50:03d}", 1, 2, "") for i in range(2000)]
    rows += [(100 + i // 2, i % 2, ("user", "assistant")[i % 2], "x", 1, 2, "") for i in range(2000)]
    df = spark.createDataFrame(rows, SAID).repartition(7)
    hot = sorted((r, x) for c, _, r, x, *_ in rows if c == 7)
    got = read(chat_format.read_back(chat_format.format_conversations(df, block_chars=200)))
    assert len(got) == 1001 and got[7] == brute_talk(hot) and got[100] == brute_talk([("user", "x"), ("assistant", "x")])
    assert read(chat_format.read_back(chat_format.format_conversations(df.where("false")))) == {}


def test_escaping_is_reversible_and_hides_marks():
    add, drop = chat_format.INSTRUCT.escapes()
    rng = np.random.default_rng(2)
    pieces = ["[", "]", "<", ">", "\\", "/", "s", "INST", "SYS", "ROLE", "s>", "[INST]", "</s>", " "]
    for _ in range(3000):
        text = "".join(rng.choice(pieces, size=rng.integers(0, 12)))
        hidden = add.sub(r"\g<0>\\", text)
        assert drop.sub("", hidden) == text and not any(c in hidden for c in chat_format.INSTRUCT.controls)


def test_template_must_be_parsable():
    good = chat_format.INSTRUCT
    for turns in ({"user": ("plain ", chat_format.TEXT, " </s>")}, {"user": ("[A] ", chat_format.TEXT, "\n")},
                  {"user": ("[A] ", chat_format.TEXT, "</s>"), "bot": ("[A] x", chat_format.LEARNT, "</s>")}, {"user": ("[A]", chat_format.TEXT)}):
        with pytest.raises(ValueError):
            chat_format.Template(turns, good.other, good.moves, good.accepting)


# --- fill-in-middle -----------------------------------------------------------------------------------------------------

DOCS = "doc_id long, text string, form string, n int, frames string, units long, cut1 int"
TEXTS = [
    None, "", "x", "a b", "holds <P> a mark", "<S>", "almost <M a mark <P", " \n\t", "日本語 mixed with words 🙂🙂 and naïve é",
    "z" * 300_000, "word " * 40_000, "é" * 90_000, "q" * 70_000 + " mid " + "r" * 140_000, "<" * 50, "P><S", "one two three four five six",
]
_UNIT = re.compile("[A-Za-z]+|[^A-Za-z]")


def brute_middle(i, text):
    units = _UNIT.findall(text)
    n, digest = len(units), hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k:8 * k + 8], 16) for k in range(4))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("frame", [1, 7, 1 << 16])
def test_middle_equals_brute_force(spark, frame, monkeypatch):
    texts = [t for t in TEXTS if frame > 7 or len(t or "") < 1000]
    rows = [(i, texts[i % len(texts)]) for i in range(12 * len(texts))] + [(None, "null id"), (3, texts[3]), (3, texts[3])]
    docs = spark.createDataFrame([(*r, "clash", 1, "c", 2, 3) for r in rows], DOCS)
    stored = fill_middle.materialize(fill_middle.frames_of(docs, frame_bytes=frame))
    out = fill_middle.fill_in_middle(stored)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    key = lambda r: tuple("" if x is None else str(x) for x in r)
    want = [(i, *brute_middle(i, t or ""), t or "") for i, t in rows]
    got = [(r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output_sha256"], r["restored_sha256"])
           for r in fill_middle.digests(out).collect()]
    assert sorted(got, key=key) == sorted([(*w[:5], sha(w[5]), sha(w[6])) for w in want], key=key)
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    texts = sorted(((r["doc_id"], r["text"]) for r in fill_middle.text_of(out).collect()), key=key)
    assert texts == sorted([(w[0], w[5]) for w in want], key=key)


def test_middle_of_empty_table(spark):
    docs = spark.createDataFrame([], DOCS)
    assert fill_middle.digests(fill_middle.fill_in_middle(fill_middle.store_frames(docs))).collect() == []
