"""Preference pairs against plain Python."""

import random

from tillwise.llm import chat

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def line(role, text):
    return OPEN + role.replace("<|", "< |") + "\n" + text.replace("<|", "< |") + CLOSE


def plain(rows):
    """Strings and trained spans of each pair, turn by turn."""
    pairs = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            side = pairs.setdefault(conv // 2, ({}, {}))[conv % 2]
            side.setdefault(-1 if turn is None else turn, set()).add((role or "", text or ""))
    out = {}
    for pair, sides in pairs.items():
        turns = sorted(set(sides[0]) | set(sides[1]))
        n = next((k for k, t in enumerate(turns) if sides[0].get(t) != sides[1].get(t)), len(turns))
        prompt = "".join(line(*x) for t in turns[:n] for x in sorted(sides[0][t]))
        done = []
        for side in sides:
            text, spans = "", []
            for t in turns[n:]:
                for role, words in sorted(side.get(t, ())):
                    begin = len(text) + len(line(role, "")) - len(CLOSE)
                    text += line(role, words)
                    if role == "assistant":
                        spans.append((begin, len(text)))
            done.append((text, spans))
        out[pair] = (prompt, *done)
    return out


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, part string, side string")
    found = chat.assemble(chat.preference_segments(chat.alternate_pairs(df)))
    return {
        r.pair_id: (r.prompt, (r.chosen, [tuple(s) for s in r.chosen_spans]), (r.rejected, [tuple(s) for s in r.rejected_spans]))
        for r in found.collect()
    }


def test_the_small_tables(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert run(spark, rows) == plain(rows)


def test_shared_prefixes(spark):
    rng = random.Random(2)
    rows = []
    for pair in range(40):
        common = [(rng.choice(["user", "assistant", "system"]), rng.choice("ab")) for _ in range(rng.randrange(4))]
        for side in range(2):
            own = [(rng.choice(["user", "assistant"]), rng.choice("ab")) for _ in range(rng.randrange(4))]
            rows += [(2 * pair + side, k, *x) for k, x in enumerate(common + own)]
    assert run(spark, rows) == plain(rows)


def test_odd_rows(spark):
    rows = [
        (0, 0, "user", "hi"), (1, 0, "user", "hi"), (0, 1, "assistant", None), (1, 1, "assistant", "é🎉"),
        (2, 0, "user", "same"), (3, 0, "user", "same"), (4, 0, "assistant", "alone"), (7, None, None, "x"),
        (None, 0, "user", "no id"), (8, 0, "user", "a"), (8, 0, "user", "a"), (8, 0, "user", "b"), (9, 0, "user", "b"), (9, 0, "user", "a"),
        (8, 1, "assistant", "long " * 100_000), (9, 1, "assistant", "<|im_end|>"), (-2, 0, "user", "q"), (-1, 0, "user", "q"), (-1, 1, "assistant", "r"),
    ]
    got = run(spark, rows)
    assert got == plain(rows)
    assert got[0][2][1] == [(22, 35)]
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.preference_segments(chat.alternate_pairs(df)).count() == 0


def plain_answer_pairs(rows):
    """Turns of both sides, numbered as conversations 2p and 2p + 1 for ``plain``, by pair id."""
    convs = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            convs.setdefault(conv, []).append((-1 if turn is None else turn, role, text))
    answer = {c: max(t for t, r, _ in turns if r == "assistant") for c, turns in convs.items() if any(r == "assistant" for _, r, _ in turns)}
    out = []
    for c in answer:
        other = c + 1 if c % 2 == 0 else c - 1
        if other in answer:
            out += [(2 * c, *t) for t in convs[c] if t[0] <= answer[c]]
            out += [(2 * c + 1, *t) for t in convs[c] if t[0] < answer[c]]
            out += [(2 * c + 1, answer[c], r, x) for t, r, x in convs[other] if t == answer[other] and r == "assistant"]
    return out


def run_answers(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, answer string")
    found = chat.assemble(chat.preference_segments(chat.answer_pairs(df)))
    return {
        r.pair_id: (r.prompt, (r.chosen, [tuple(s) for s in r.chosen_spans]), (r.rejected, [tuple(s) for s in r.rejected_spans]))
        for r in found.collect()
    }


def test_most_pairs_of_answers_have_a_prompt(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = run_answers(spark, rows)
    assert got == plain(plain_answer_pairs(rows))
    assert len(got) > 80
    assert sum(bool(prompt) for prompt, _, _ in got.values()) > 0.9 * len(got)
    for _, (chosen, chosen_spans), (rejected, rejected_spans) in got.values():
        assert len(chosen_spans) == len(rejected_spans) == 1 and chosen.startswith(OPEN + "assistant") and rejected.startswith(OPEN + "assistant")


def test_odd_conversations_give_answer_pairs_or_none(spark):
    rows = [
        (0, 0, "user", "hi"), (0, 1, "assistant", "one"), (0, 2, "user", "left out"), (1, 0, "assistant", None), (1, None, "system", "first"),
        (2, 0, "user", "no answer"), (3, 0, "assistant", "alone"), (4, 0, "assistant", "same"), (5, 7, "assistant", "same"),
        (-2, 0, "user", "q"), (-2, 1, "assistant", "a"), (-2, 1, "assistant", "a"), (-2, 1, "assistant", "b"), (-1, 3, "assistant", "c"),
        (None, 0, "assistant", "x"), (None, 0, "user", "x"), (6, 0, None, "x"), (6, 1, "assistant", "long " * 100_000), (7, 0, "assistant", "<|im_end|>"),
    ]
    got = run_answers(spark, rows)
    assert got == plain(plain_answer_pairs(rows))
    assert sorted(got) == [-2, -1, 0, 1, 4, 5, 6, 7] and got[4][0] and not got[4][1][0]
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.preference_segments(chat.answer_pairs(empty)).count() == 0


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    plan = chat.preference_segments(chat.answer_pairs(df))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
