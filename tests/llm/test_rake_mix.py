import hashlib
import re
from collections import defaultdict

from lociform.llm import rake_mix as R

TEXTS = ["a b c", None, "", "x | y", "one 1 two", "w " * 500, "q\tz\x0b"]


def rows():
    out = []
    for k in range(400):
        out.append((k, TEXTS[k % len(TEXTS)] if k % 3 else "m n o p " * (k % 11), ["big", "big", "b", None][k % 4], ["en", "de", None][k % 3 if k % 5 else 0]))
    return out + out[:3] + [(None, "a b", "b", "en")]


def brute(data, budget, powers=(0.7, 0.8, 0.8)):
    def topic(t):
        return "table" if "|" in (t or "") else "figures" if re.search("[0-9]", t or "") else "prose"

    docs = [(k, (s or "", la or "", topic(t)), len(re.findall(R.WORD, t or ""))) for k, t, s, la in data]
    cells = defaultdict(int)
    for _, c, n in docs:
        cells[c] += n
    total = sum(cells.values())
    targets = []
    for d, power in enumerate(powers):
        t = defaultdict(int)
        for c, n in cells.items():
            t[c[d]] += n
        whole = set()
        while True:  # values that cannot give their share give all, the others share the rest
            rate = (budget * total - sum(t[v] for v in whole)) / sum(n**power for v, n in t.items() if v not in whole)
            more = {v for v, n in t.items() if n < rate * n**power}
            if more <= whole:
                break
            whole |= more
        targets.append({v: min(n, rate * n**power) for v, n in t.items()})
    p = dict.fromkeys(cells, budget)

    def sums(d):
        have = defaultdict(float)
        for c, n in cells.items():
            have[c[d]] += n * p[c]
        return have

    miss = lambda: max(abs(sums(d)[v] - t) / (budget * total) for d in range(3) for v, t in targets[d].items())
    sweeps = 0
    while miss() > R.TOLERANCE and sweeps < R.MOST_SWEEPS:
        for _ in range(R.BLOCK_SWEEPS):
            for d in range(3):
                have = sums(d)
                full = defaultdict(float)
                for c, n in cells.items():
                    full[c[d]] += n * (p[c] >= 1)
                for c in cells:
                    t, h, f = targets[d][c[d]], have[c[d]], full[c[d]]
                    if h and t <= h:
                        p[c] *= t / h
                    elif h and p[c] < 1 and h > f:
                        p[c] = min(1.0, p[c] * max(1.0, (t - f) / (h - f)))
        sweeps += R.BLOCK_SWEEPS
    out = []
    for k, c, n in docs:
        u = int(hashlib.md5(b"" if k is None else str(k).encode()).hexdigest()[:8], 16) / 2**32
        out.append((k, *c, n, round(p[c] / budget, 6), u < p[c]))
    return sorted(out, key=str), cells, p, targets, miss()


def test_against_brute_force(spark):
    df = spark.createDataFrame([(*r, 1) for r in rows()], "doc_id bigint, text string, source string, lang string, weight int")
    want, cells, p, targets, miss = brute(rows(), R.BUDGET)
    got = R.mix(df, ["doc_id"]).collect()
    assert sorted(((r.doc_id, r.source, r.lang, r.topic, r.n_tokens, round(r.weight, 6), r.selected) for r in got), key=str) == want
    assert {r.miss for r in got} == {round(miss, 5)}
    assert all(0 <= x <= 1 for x in p.values())


def test_margins_hold_within_tolerance(spark):
    cells = [(f"s{a}", f"l{b}", 100 + 37 * a * b + 1000 * (a == 0)) for a in range(6) for b in range(4)]
    c = R.cells_of(spark.createDataFrame(cells, "source string, lang string, n_tokens bigint"), ["source", "lang"])
    t = {m: R.tempered(c, m, 0.8) for m in ("source", "lang")}
    one, miss = R.rake(c, t)
    assert miss <= R.TOLERANCE
    for r in R.misses(one, ["source", "lang"]).collect():
        assert abs(r.have - r.target) <= R.TOLERANCE * R.BUDGET * sum(n for *_, n in cells) + 1e-6
    many, _ = R.rake(c, t, one_task=0)
    by = lambda x: {(r.source, r.lang): round(r.p, 9) for r in x.collect()}
    assert by(one) == by(many)


def test_own_topics(spark):
    df = spark.createDataFrame([(k, "a b c", "s", "en", ["law", "sport", None][k % 3]) for k in range(30)], "doc_id bigint, text string, source string, lang string, subject string")
    assert {r.topic for r in R.mix(df, ["doc_id"], topic="subject").collect()} == {"law", "sport", ""}


def test_very_long_and_empty(spark):
    df = spark.createDataFrame([(1, "word " * 400_000, "s", "en"), (2, None, None, None), (2, "", "s", "en")], "doc_id bigint, text string, source string, lang string")
    got = {(r.doc_id, r.n_tokens) for r in R.mix(df, ["doc_id"]).collect()}
    assert got == {(1, 400_000), (2, 0)}
    assert R.mix(df.where("false"), ["doc_id"]).count() == 0


def test_stage(spark):
    df = spark.createDataFrame([(*r, "x") for r in rows()], "doc_id bigint, text string, source string, lang string, topic string")
    out = R.mix_stage(df)
    assert out.columns == df.columns
    want, *_ = brute(rows(), R.BUDGET)
    assert sorted((r.doc_id for r in out.collect()), key=str) == sorted((r[0] for r in want if r[-1]), key=str)
    assert R.mix_stage(df.where("false")).count() == 0
