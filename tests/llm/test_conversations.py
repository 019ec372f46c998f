import random
from datetime import datetime

import numpy as np
import pytest

from tallyspark.llm.conversations import COLUMNS, conversations, peel

C = "comment_id long, thread_id string, pr_id long, in_reply_to_id long, author string, body string, created_at string, ingested_at timestamp_ntz"
T = "event_id long, event_type string, actor string, data string"
P = "id long, pr_author string"
B = "github_username string"
NOW = datetime(2026, 1, 1)


def row(i, thread, reply, author="ann", body="text", at=None, pr=1):
    return (i, thread, pr, reply, author, body, str(1_750_000_000 + (i if at is None else at)), NOW)


def run(frame, rows, events=(), prs=((1, "Ann[bot]"),), bots=("Helper[bot]",), **kw):
    return conversations(frame(list(rows), C), frame(list(events), T), frame(list(prs), P), frame([(b,) for b in bots], B), **kw)


def turns(df):
    return sorted((r.thread_id, r.turn_no, r.comment_id, r.speaker_role) for r in df.collect())


GOOD = [row(1, "g", None, "HELPER"), row(2, "g", 1, "ann", at=9), row(3, "g", 2, "bob", at=5), row(4, "g", 1, "helper[bot]", body=" ​\n")]
WANT = [("g", 1, 1, "bot"), ("g", 2, 3, "reviewer"), ("g", 3, 2, "author")]


@pytest.mark.parametrize("limit", [200_000, 3])
def test_kept_and_dropped_threads(frame, limit):
    rows = [
        *GOOD,
        row(10, "two roots", None), row(11, "two roots", None, "bob"),
        row(20, "cycle", None), row(21, "cycle", 22, "bob"), row(22, "cycle", 21, "bob"),
        row(30, "nowhere", None), row(31, "nowhere", 999, "bob"), row(32, "nowhere", 31, "bob"),
        row(40, "all cycle", 41), row(41, "all cycle", 40, "bob"), row(42, "self", 42), row(43, "self", None, "bob"),
        row(50, "alone", None), row(51, "alone", 50, "ANN"), row(60, "blank", None), row(61, "blank", 60, "bob", body=None),
        row(70, "nobody", None), row(71, "nobody", 70, None), row(80, "other", 1), row(90, "one", None),
    ]
    assert turns(run(frame, rows, task_rows=limit)) == WANT
    assert turns(run(frame, rows * 2, task_rows=limit)) == WANT


def test_missing_author_from_the_timeline(frame):
    rows = [row(1, "t", None, "ann"), row(2, "t", 1, " "), row(3, "u", None, "ann"), row(4, "u", 3, "UNKNOWN"), row(5, "v", None, "ann"), row(6, "v", 5, None)]
    events = [(1, "review_comment", "Bob", '{"comment_id": 2}'), (2, "review_comment", "unknown", '{"comment_id": 4}'), (3, "issue_comment", "bob", '{"comment_id": 4}'), (4, "review_comment", "Helper", '"{\\"comment_id\\": 6}"'), (5, "review_comment", None, None), (6, "review_comment", "x", "{")]
    assert turns(run(frame, rows, events)) == [("t", 1, 1, "author"), ("t", 2, 2, "reviewer"), ("v", 1, 5, "author"), ("v", 2, 6, "bot")]


def test_ties_zones_nulls_and_empty(frame):
    rows = [(1, "t", 1, None, "ann", "x", "2025-06-01T12:00:00Z", NOW), (3, "t", 1, 1, "bob", "x", "2025-06-01T14:00:00+02:00", NOW), (2, "t", 1, 1, "bob", "x", "1748779200000", NOW), (4, "t", None, 1, "cid", "x", "2025-06-01 07:59:59 EDT", NOW), (None, "t", 1, 1, "a", "b", None, None), (9, None, 1, None, "a", "b", None, None)]
    assert [t[2] for t in turns(run(frame, rows))] == [4, 1, 2, 3]
    assert run(frame, []).collect() == []
    assert turns(run(frame, GOOD, prs=[(1, None)], bots=[])) == [("g", 1, 1, "reviewer"), ("g", 2, 3, "reviewer"), ("g", 3, 2, "reviewer")]


def brute(rows):
    """Threads by plain walking."""
    out = []
    for t in {r[1] for r in rows}:
        own = {r[0]: r for r in rows if r[1] == t}
        roots = [i for i, r in own.items() if r[3] is None]

        def leads(i, own=own, roots=roots):
            seen = set()
            while i in own and i not in seen:
                seen.add(i)
                if own[i][3] is None:
                    return i == roots[0]
                i = own[i][3]
            return False

        said = sorted((int(r[6]), r[0]) for r in own.values() if r[5])
        if len(roots) == 1 and all(map(leads, own)) and all(r[4] for r in own.values()) and len({own[i][4] for _, i in said}) > 1:
            out += [(t, k, i) for k, (_, i) in enumerate(said, 1)]
    return sorted(out)


@pytest.mark.parametrize("limit", [200_000, 40])
def test_against_plain_walking(frame, limit):
    rng = random.Random(7)
    rows, n = [], 0
    for t in range(60):
        ids = list(range(n, n := n + rng.randint(1, 12)))
        for k, i in enumerate(ids):
            up = None if k == 0 else rng.choice(ids[:k]) if rng.random() < 0.93 else rng.choice([*ids, 10**6])
            rows.append(row(i, f"t{t}", up, rng.choice(["ann", "bob", "cid"]) if rng.random() < 0.97 else None, rng.choice(["x", "x", None]), rng.randrange(50)))
    rng.shuffle(rows)
    got = run(frame, rows, task_rows=limit)
    assert sorted((r.thread_id, r.turn_no, r.comment_id) for r in got.collect()) == brute(rows)


def test_all_columns_are_the_same_both_ways(frame):
    rows = [row(i, "long", i - 1 if i else None, "ab"[i % 2], at=(i * 7) % 31) for i in range(30)] + [row(100 + i, "star", 100 if i else None, "abb"[i % 3]) for i in range(20)]
    both = [sorted(tuple(r) for r in run(frame, rows, bots=["a"], task_rows=limit).select(*COLUMNS).collect()) for limit in (200_000, 12)]
    assert both[0] == both[1] and {r[2]: r[4] for r in both[0]}[29] == 29


def test_topological_order_roles_and_wrong_clocks(frame):
    # 2 and 4 answer 1; 3 answers 2 before its time; 5 goes on below 4
    rows = [row(1, "t", None, "ann", at=10), row(2, "t", 1, "bob", at=30), row(3, "t", 2, "helper", at=5), row(4, "t", 1, "cid", at=40), row(5, "t", 4, "ann", at=50), row(6, "t", 2, "bob", at=35)]
    alt = [row(11, "u", None, "helper", at=1), row(12, "u", 11, "ann", at=2), row(13, "u", 12, "bob", at=3)]
    got = sorted(run(frame, rows + alt).collect(), key=lambda r: (r.thread_id, r.turn_no))
    assert [r.comment_id for r in got] == [3, 1, 2, 6, 4, 5, 11, 12, 13]
    assert [r.comment_id for r in sorted(got[:6], key=lambda r: r.kahn_no)] == [1, 2, 4, 3, 6, 5]
    assert {r.comment_id: r.depth for r in got[:6]} == {1: 0, 2: 1, 4: 1, 3: 2, 6: 2, 5: 2}
    assert {(r.thread_id, r.roles_alternate) for r in got} == {("t", False), ("u", True)}


def test_a_comment_delivered_for_two_threads_keeps_one_delivery_whole(frame):
    first, later = row(2, "t", 1, "bob"), list(row(2, "a", 77, "ann", body=" "))
    later[7] = datetime(2026, 2, 1)
    assert [r[:3] for r in turns(run(frame, [row(1, "t", None), first, tuple(later)]))] == [("t", 1, 1), ("t", 2, 2)]


def test_peel_is_linear_in_a_long_chain():
    n = 50_000
    ident = np.arange(n)[::-1].copy()
    freed = peel(np.zeros(n, np.int64), ident, ident - 1, ident > 0, ident)
    assert (freed == ident).all()
