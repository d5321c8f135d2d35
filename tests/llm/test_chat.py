import itertools
import random
import re

import pytest

from ruleframe.llm import chat

NEXT = {"start": {"system", "user"}, "system": {"user"}, "user": {"assistant"}, "assistant": {"user"}}


def cheapest(roles):
    """Least cost over all ways to merge, relabel and insert, tried one by one."""
    frontier = {"start": 0}

    def inserted(costs):
        costs = dict(costs)
        for _ in range(3):
            for s, c in list(costs.items()):
                for n in NEXT[s] - {"system"}:
                    costs[n] = min(costs.get(n, 10**9), c + chat.INSERT)
        return costs

    for r in roles:
        after = {}
        for s, c in frontier.items():
            if s != "start":
                cost = chat.MERGE_SAME if r == s else chat.MERGE_UNKNOWN if r is None else chat.MERGE_OTHER
                after[s] = min(after.get(s, 10**9), c + cost)
        for s, c in inserted(frontier).items():
            for n in NEXT[s]:
                cost = 0 if n == r else chat.RELABEL_UNKNOWN if r is None else chat.RELABEL
                after[n] = min(after.get(n, 10**9), c + cost)
        frontier = after
    return min(c for s, c in inserted(frontier).items() if s == "assistant")


def roles_in(rendered):
    assert re.fullmatch(r"(<\|(system|user|assistant)\|>\n(?:(?!<\|).|\n)*<\|end\|>\n)+", rendered), rendered
    return re.findall(r"<\|(system|user|assistant)\|>", rendered)


def run(spark, rows, parts):
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, action string, cost int")
        return sorted((tuple(r) for r in chat.repair(df).collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_rendered_conversations(spark):
    rng = random.Random(5)
    rows = [(c, t, rng.choice(["user", "assistant", "gpt", None]), f"c{c}t{t}", "a", 1) for c in range(6) for t in range(rng.choice((1, 3, 200)))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, action string, part int").repartition(3)
    want, got = {}, {}
    for r in sorted(chat.repair(df).collect(), key=lambda r: (r.conv_id, r.turn)):
        want[r.conv_id] = want.get(r.conv_id, "") + r.piece
    for r in sorted(chat.render(df).collect(), key=lambda r: (r.conv_id, r.part)):
        got[r.conv_id] = got.get(r.conv_id, "") + r.text
    assert got == want
    for text in got.values():
        roles_in(text)


@pytest.mark.parametrize("parts", [1, 9])
def test_all_short_conversations(spark, parts):
    rows = []
    lists = [c for n in range(1, 5) for c in itertools.product(["system", "user", "assistant", None], repeat=n)]
    for i, c in enumerate(lists):
        rows += [(i, t, r, f"t{t}") for t, r in enumerate(c)]
    got = {}
    for r in run(spark, rows, parts):
        got.setdefault(r[0], []).append(r)
    assert len(got) == len(lists)
    for i, c in enumerate(lists):
        own = sorted(got[i], key=lambda r: r[1])
        assert sum(r[5] for r in own) == cheapest(c), c
        rendered = "".join(r[7] for r in own)
        shown = roles_in(rendered)
        assert shown[-1] == "assistant" and shown[0] in NEXT["start"] and all(b in NEXT[a] for a, b in itertools.pairwise(shown))
        assert all(rendered.count(f"t{t}") == 1 for t in range(len(c)))
        assert [r[6] for r in own] == [False] * (len(own) - 1) + [True]


def test_hot_conversation_does_not_depend_on_partitions(spark):
    rng = random.Random(2)
    rows = [(7, t, rng.choice(["user", "assistant", "bot", "system", None]), f"m{t}") for t in range(500)] + [(8, 0, "assistant", "z"), (6, 0, "user", None)]
    one = run(spark, rows, 1)
    assert run(spark, rows, 12) == one and run(spark, rows, 40) == one
    roles = [chat.role_of(r[2]) for r in rows[:500]]
    assert sum(r[5] for r in one if r[0] == 7) == cheapest(roles)


def test_odd_rows(spark):
    rows = [(None, None, None, None), (None, 1, "user", "a"), (1, 0, "user", "a"), (1, 0, "user", "a"), (2, 0, " Human ", ""), (2, 1, "GPT", "y" * 100_000)]
    got = run(spark, rows, 3)
    assert len(got) == len(rows)
    assert sum(r[6] for r in got) == 3
    assert chat.repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
