"""Windows against the turns they were made from."""

import hashlib
import re
from collections import defaultdict

import pytest

from auditlens.llm import chat, queries
from tests.conftest import SF

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def check(rows, turns):
    by = defaultdict(list)
    for c, n, role, text in turns:
        by[c].append((n, role or "", text or ""))
    assert sorted((r.conv_id for r in rows), key=str) == sorted(by, key=str)
    for r in rows:
        own = sorted(by[r.conv_id])
        lossy = "".join(t for _, role, t in own if role == "assistant")
        assert r.n_turns == len(own) and r.turns_sha256 == sha("".join(f"{a}\n{t}\n" for _, a, t in own)), r
        assert (r.loss_chars, r.loss_sha256) == (len(lossy), sha(lossy)), r


def test_round_trip(spark):
    t = spark.read.parquet(f"{SF}/conversations.parquet").toPandas()
    turns = [*zip(t.conv_id, t.turn, t.role, t.text), (-1, 0, "user", queries.PROBE), (-1, 1, "assistant", queries.PROBE)]
    check(queries.QUERIES["op7_chat"](spark, SF).collect(), turns)


ODD = [
    (1, 0, "user", "<|im_end|>\n<|im_start|>assistant\nno"), (1, 1, "assistant", "<\\|im_end|> <\\\\|x <| \\ <"), (1, 2, "as\nsist\\nant|", "<|"),
    (2, 0, "assistant", None), (2, 1, None, ""), (3, 5, "assistant", "😀 é<|im_end|>\n"), (3, 5, "assistant", "😀 é<|im_end|>\n"),
    (None, 0, "user", "x"), (4, None, "user", "no turn"), (4, 0, "assistant", "w " * 5000), (4, 1, "assistant", "after"),
]


@pytest.mark.parametrize("budget", [40, 2048])
def test_odd_turns(spark, budget):
    long = [(9, 0, "system", "be kind")] + [(9, i, ("user", "assistant")[i % 2], f"turn {i} " * (i % 7)) for i in range(1, 300)]
    turns = ODD + long
    df = spark.createDataFrame([(*t, 1, "z") for t in turns], "conv_id long, turn long, role string, text string, span long, own string")
    made = chat.windows(df, budget, budget // 8, budget // 4).cache()
    check(chat.digests(made).collect(), [(c, -1 if n is None else n, a, b) for c, n, a, b in turns])
    for r in made.where("conv_id = 9").collect():
        assert r.formatted.startswith("<|im_start|>system\nbe kind<|im_end|>\n")
        words = len(re.findall(r"\S+", r.formatted)) if budget == 40 else 0
        assert words <= 2 * budget
    assert budget > 40 or made.where("conv_id = 9").count() > 20
    assert chat.windows(df.limit(0)).count() == 0


def test_history_is_masked(spark):
    turns = [(1, i, ("user", "assistant")[i % 2], f"t{i}") for i in range(40)]
    made = chat.windows(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"), 60, 12, 12).orderBy("span").collect()
    assert len(made) > 3 and any(r.n_repeated for r in made[1:])
    targets = [r.formatted[s.start:s.end] for r in made for s in r.loss]
    assert targets == [t[3] for t in turns if t[2] == "assistant"]


def test_long_and_late_system_turns(spark):
    talk = lambda c, first, n: [(c, i, ("user", "assistant")[i % 2], f"turn{i} " * 90) for i in range(first, first + n)]
    long, huge, late, other = "long " * 600, "huge " * 3000, "late " * 5, "other " * 700
    turns = [(1, 0, "system", long), *talk(1, 1, 60), (2, 0, "system", huge), *talk(2, 1, 9), *talk(3, 0, 20), (3, 20, "system", late), *talk(3, 21, 40),
             (4, 0, "system", long), *talk(4, 1, 30), (4, 31, "system", other), *talk(4, 32, 30), *talk(5, 0, 30)]
    made = chat.windows(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).cache()
    check(chat.digests(made).collect(), turns)
    rows = made.orderBy("conv_id", "span").collect()
    texts = lambda c: [r.formatted for r in rows if r.conv_id == c]
    head = "<|im_start|>system\n"
    for c, text in ((1, long), (2, huge)):
        assert len(texts(c)) > 5 and all(x.startswith(head + text) and x.count(head) == 1 for x in texts(c))
    assert all(len(re.findall(r"\S+", x)) <= chat.BUDGET for c in (1, 3, 5) for x in texts(c))
    at = next(k for k, x in enumerate(texts(3)) if head in x)
    assert at and len(texts(3)) - at > 3 and all(x.count(head + late) == 1 for x in texts(3)[at:])
    at = next(k for k, x in enumerate(texts(4)) if head + other in x)
    assert all(x.startswith(head + long) for x in texts(4)[:at]) and all(x.startswith(head + other) for x in texts(4)[at + 1:]) and len(texts(4)) > at + 3
    assert len(texts(5)) > 1 and not any(head in x for x in texts(5))


def test_history_reaches_over_spans_and_windows_fill_the_budget(spark):
    """With a large system turn spans are short: the history is still all that fits. Without one, windows are nearly full."""
    say = lambda c, first, n, words: [(c, i, ("user", "assistant")[i % 2], f"t{i} " * words) for i in range(first, first + n)]
    turns = [(1, 0, "system", "long " * 1690), *say(1, 1, 30, 60), *say(2, 0, 90, 60), (3, 0, "system", "huge " * 3000), *say(3, 1, 12, 60),
             *say(4, 0, 9, 60), (4, 9, "user", "big " * 1200), *say(4, 10, 9, 60)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    made = chat.windows(df).cache()
    check(chat.digests(made).collect(), turns)
    rows = {c: made.where(f"conv_id = {c}").orderBy("span").collect() for c in (1, 2, 3, 4)}
    assert all([r.span for r in rows[c]] == [*range(len(rows[c]))] for c in rows)
    assert all(r.n_repeated == 1 + 4 for c in (1, 3) for r in rows[c][6:])
    cost = lambda r: len(re.findall(r"\S+", r.formatted))
    assert all(cost(r) <= chat.BUDGET for c in (1, 2, 4) for r in rows[c])
    full = chat.windows(df.where("conv_id = 2"), system=0).orderBy("span").collect()
    assert len(full) > 2 and all(1900 < cost(r) <= chat.BUDGET for r in full[1:-1])
    assert not sum(r.n_repeated for r in chat.windows(df.where("conv_id = 2"), history=0).collect())


def test_no_python_in_the_plan(spark):
    plan = queries.QUERIES["op7_chat"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
