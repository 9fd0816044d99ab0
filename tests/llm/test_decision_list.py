"""The learned decision list against a plain search over the rows themselves."""

import math
import random
import zlib

import pytest

from weftline.llm import quality_rules

KIND = "doc_id long, text string"


def plain_features(s):
    share = lambda a, b: a / b if b else 0.0
    return {
        "symbol_share": share(s.n_symbols, s.word_chars), "repeat_share": share(s.n_repeat_words, s.n_words), "dup_line_share": share(s.n_dup_lines, s.n_lines), "mean_word": share(s.word_chars, s.n_words),
        "upper_share": share(s.n_upper, s.word_chars), "mark_share": share(s.n_marks, s.n_words), "log_words": math.log1p(s.n_words),
    }


def plain_list(rows, bins=16, max_rules=8, max_tests=3, precision=0.9, covered=5):
    """Rules as lists of (feature, cut, above), from rows (id, features, label): every test is tried on every row, at every step."""
    cuts = {}
    for f in rows[0][1]:
        ordered = sorted(x[f] for _, x, _ in rows)
        cuts[f] = sorted({ordered[max(1, math.ceil(len(rows) * k / bins)) - 1] for k in range(1, bins)})
    holds = lambda x, rule: all((x[f] > c) == above for f, c, above in rule)
    tell = lambda part, rule: (sum(y == 0 and holds(x, rule) for _, x, y in part), sum(y == 1 and holds(x, rule) for _, x, y in part))
    grow = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3]
    prune = [r for r in rows if not zlib.crc32(str(r[0]).encode()) % 3]
    rules = []
    while len(rules) < max_rules:
        rule = []
        p0, n0 = tell(grow, [])
        while p0 and n0 and len(rule) < max_tests:
            best = None
            for f in cuts:
                for c in cuts[f]:
                    for above in (True, False):
                        p, n = tell(grow, [*rule, (f, c, above)])
                        gain = p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0
                        if best is None or (gain, -n) > best[:2]:
                            best = gain, -n, p, (f, c, above)
            if best is None or best[0] <= 0:
                break
            rule.append(best[3])
            p0, n0 = best[2], -best[1]
        if not rule:
            break
        worth = []
        for k in range(len(rule), 0, -1):
            p, n = tell(prune, rule[:k])
            worth.append(((p - n) / max(1, p + n), -k, p, n))
        _, k, p, n = max(worth)
        if p < covered or p < precision * (p + n):
            break
        rule = rule[:-k]  # k is minus the number of tests
        rules.append(rule)
        grow, prune = ([r for r in part if not holds(r[1], rule)] for part in (grow, prune))
    middles = {}
    for f, c, _ in {t for rule in rules for t in rule}:
        below, above = [x[f] for _, x, _ in rows if x[f] <= c], [x[f] for _, x, _ in rows if x[f] > c]
        middles[f, c] = (max(below) + min(above)) / 2 if below and above else c
    return [[(f, middles[f, c], above) for f, c, above in rule] for rule in rules]


def made(seed, n):
    r = random.Random(seed)
    docs, marks = [], []
    for i in range(n):
        kind = r.choice(["good", "good", "good", "symbols", "loud", "lines", "long words"])
        words = ["".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 9))) for _ in range(r.randrange(50, 90))]
        if kind == "symbols":
            words = [w + r.choice(["", "#", "$%"]) for w in words]
        elif kind == "loud":
            words = [w.upper() + r.choice(["", "!"]) for w in words]
        elif kind == "long words":
            words = [w * 3 for w in words]
        text = "".join(w + ("\n" if k % 9 == 8 else " ") for k, w in enumerate(words))
        if kind == "lines":
            text += "again and again it says\n" * r.randrange(2, 6)
        docs.append((i, text))
        bad = kind != "good" if r.random() > 0.04 else kind == "good"
        marks.append((i, 0 if bad else 1))
    # A label twice, null labels, labels of nobody and of a null id.
    return docs, marks + [marks[0], (1, None), (n + 5, 0), (None, 1), (2, 7)]


@pytest.mark.parametrize("seed, n", [(1, 260), (2, 420)])
def test_list_equals_the_plain_one(spark, seed, n):
    docs, marks = made(seed, n)
    stats = quality_rules.text_stats(spark.createDataFrame(docs, KIND).repartition(3), keep=["doc_id"])
    counted = {x.doc_id: x for x in stats.select("doc_id", "_stats.*").collect()}
    found = quality_rules.learn(stats, spark.createDataFrame(marks, "doc_id long, quality int"))
    rows = [(i, plain_features(counted[i]), y) for i, y in marks if i in counted and y in (0, 1)]
    want = plain_list(rows)
    assert len(want) >= 2
    assert [[(t.feature, t.above) for t in rule] for rule in found.rules] == [[(f, above) for f, _, above in rule] for rule in want]
    for rule, plain in zip(found.rules, want, strict=True):
        assert [t.cut for t in rule] == pytest.approx([c for _, c, _ in plain], rel=1e-12)
    kept = {x.doc_id: x.kept for x in stats.select("doc_id", found.kept().alias("kept")).collect()}
    for i, s in counted.items():
        x = plain_features(s)
        assert kept[i] == (not any(all((x[f] > c) == above for f, c, above in rule) for rule in want))
