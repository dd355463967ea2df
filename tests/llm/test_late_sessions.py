"""Session versions of late events against replays of every batch by hand."""

import random
from collections import defaultdict

import pytest
from notelake.llm import late_sessions
from notelake.llm import queries as q


def replayed(events, gap):
    """Versions of [(user, time, batch, value)], each snapshot made anew from all events so far."""
    by, out = defaultdict(list), []
    for u, t, b, v in events:
        if None not in (u, t, b):
            by[u].append((t, b, v or 0))
    for u, own in by.items():
        standing = {}  # (start, end) -> its version
        for batch in sorted({b for _, b, _ in own}):
            sessions = []
            for e in sorted(x for x in own if x[1] <= batch):
                if sessions and e[0] - sessions[-1][-1][0] <= gap:
                    sessions[-1].append(e)
                else:
                    sessions.append([e])
            for s in sessions:
                new = sum(b == batch for _, b, _ in s)
                if new:
                    start, end = s[0][0], s[-1][0]
                    old = [k for k in standing if start <= k[0] and k[1] <= end]
                    for k in old:
                        standing.pop(k)[-2:] = [batch, start]
                    version = [u, batch, start, end, len(s), new, len(old), sum(v for _, _, v in s), None, None]
                    standing[start, end] = version
                    out.append(version)
    return sorted(map(tuple, out), key=repr)


def versions(spark, events, gap=600, interval=900, lateness=3, kind="long"):
    df = spark.createDataFrame(events, f"user {kind}, time long, batch long, value long, start string")
    return sorted(map(tuple, late_sessions.session_versions(df, gap, interval, lateness).collect()), key=repr)


def random_events(seed, users, n, length, interval, lateness, steps):
    r, out = random.Random(seed), []
    for u in range(users):
        t = r.randrange(-length, length)
        for _ in range(n):
            t += r.choice(steps)
            out.append((u, t, t // interval + r.choice([0, 0, 0, *range(lateness + 1)]), r.randrange(1 << 32)))
    r.shuffle(out)
    return out


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("gap, interval, lateness", [(600, 900, 3), (9, 4, 2), (3, 10, 0), (0, 5, 1)])
def test_versions(spark, monkeypatch, seed, gap, interval, lateness):
    """Blocks of two batches and eras of two segments: sessions run over many of them."""
    monkeypatch.setattr(late_sessions, "_SPAN", 2)
    monkeypatch.setattr(late_sessions, "_ERA", 2)
    steps = [0, 1, max(1, gap // 3), gap, gap + 1, 3 * gap + interval * seed]
    events = random_events(seed, 6, 60, 4 * interval, interval, lateness, steps)
    assert versions(spark, [(*e, "x") for e in events], gap, interval, lateness) == replayed(events, gap)


def test_hot_user(spark):
    """One user with most events: a session without end over many blocks, times that repeat, others beside it."""
    events = random_events(5, 1, 3000, 100, 900, 3, [0, 60, 300, 590]) + [(9, t, b, v) for _, t, b, v in random_events(6, 1, 50, 100, 900, 3, [5, 700])]
    events += events[:40]
    assert versions(spark, [(*e, None) for e in events]) == replayed(events, 600)


def test_edges(spark):
    assert versions(spark, []) == []
    events = [(None, 5, 0, 1), (1, None, 0, 1), (1, 5, None, 1), (1, 5, 0, None), (1, 5, 0, 7), (1, 5, 1, 3)]
    assert versions(spark, [(*e, "x") for e in events]) == replayed(events, 600) == [(1, 0, 5, 5, 2, 2, 0, 7, 1, 5), (1, 1, 5, 5, 3, 1, 1, 10, None, None)]
    named = [("aé", 5, 0, 1, "x"), ("", 1000, 2, 1, "x")]
    assert versions(spark, named, kind="string") == replayed([e[:4] for e in named], 600)
    for batch in (-1, 4):
        with pytest.raises(Exception, match="lateness"):
            versions(spark, [(1, 5, batch, 1, "x")])


def test_query(spark, sf_dir):
    from zlib import crc32

    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()
    events = []
    for r in turns:
        c, h = crc32(str(r["conv_id"]).encode()), crc32(f"{r['conv_id']}:{r['turn']}".encode())
        t, g = c // 2 % 7200 + 300 * r["turn"] + h % 600, h // 600
        events.append((2 * (r["conv_id"] // 8) + c % 2, t, t // 900 + (g % 4 if g % 5 == 0 else 0), h))
    df = q.op13_late_sessions(spark, sf_dir)
    assert df.columns == ["user", "batch", "start_s", "end_s", "n_events", "n_new", "n_retracted", "h_sum", "retracted_batch", "retracted_start_s"]
    assert sorted(map(tuple, df.collect()), key=repr) == replayed(events, 600)
