"""Rule ledger, filter audit and prefix trie against brute-force versions."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tableset.llm import filter_audit, prefix_trie, quality_rules
from tableset.llm.quality_rules import BASE, POLICY, RULES, Policy, Rule

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CONVERSATIONS = "conv_id long, turn long, role string, text string, text_hash string, depth int"


# rule ledger


def brute_measures(text):
    text = text or ""
    words, lines = WORD.findall(text), text.split("\n")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if times[w] > 1 for j in range(3)}
    repeated = sum(1 for i, x in enumerate(lines) if WORD.search(x) and x in lines[:i])
    upper = sum(1 for c in text if "A" <= c <= "Z")
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), upper, len(lines), repeated, len(covered)


def brute_pattern(m):
    words, chars, symbols, upper, lines, repeated, windows = m
    fails = (words < 50, 100 * windows > 50 * words, 100 * symbols > 20 * words, 100 * repeated > 50 * lines,
             100 * chars < 250 * words, 100 * chars > 1200 * words, 100 * upper > 50 * chars)
    return sum(1 << i for i, x in enumerate(fails) if x)


def texts_of(seed, n=60):
    rng = random.Random(seed)
    words = ["a", "b", "c", "É漢🙂", "LOUD", "#x", "a|b", "<p>", "longerword" * 3]
    return ["".join(rng.choice(words) + rng.choice([" ", "\n", "\t", " \n\n"]) for _ in range(rng.choice([0, 2, 5, 60, 300]))) for _ in range(n)]


def test_measures(documents, odd):
    rows = [(i, t, "s") for i, t in enumerate(texts_of(1))]
    got = {r.id: tuple(r[m] for m in quality_rules.MEASURES) + (r.failed,) for r in quality_rules.ledger(documents(rows)).collect()}
    assert got == {i: (*(m := brute_measures(t)), brute_pattern(m)) for i, t, _ in rows}
    short = [r for r in odd.collect() if r.text is None or len(r.text) < 1000]
    got = Counter(tuple(r[m] for m in quality_rules.MEASURES) for r in quality_rules.ledger(odd).collect())
    assert not Counter(brute_measures(r.text) for r in short) - got and got.total() == odd.count()


def test_long_texts(documents):
    (row,) = quality_rules.ledger(documents([(1, "word " * 200_000 + "end", "s")])).collect()
    assert (row.n_words, row.n_repeat_words, row.word_chars) == (200_001, 200_000, 800_003)


def test_policies_and_ablations_need_no_text(spark, documents, empty):
    entries = quality_rules.ledger(documents([(i, t, "s") for i, t in enumerate(texts_of(2, 200))]))
    loose = Policy("loose", ("few_words",), ("symbols", "upper_case", "long_words"), 1)
    patterns = {r.id: r.failed for r in entries.collect()}
    bit = {r.name: 1 << i for i, r in enumerate(RULES)}

    def rejected(p, policy):
        return any(p & bit[n] for n in policy.hard) or sum(bool(p & bit[n]) for n in policy.soft) > policy.allowed

    policies = [BASE, POLICY, loose]
    got = {(r.id, r.policy): r.kept for r in quality_rules.decisions(entries, policies).collect()}
    assert got == {(i, p.version): not rejected(x, p) for i, x in patterns.items() for p in policies}
    rows = {(r.policy, r.rule): r for r in quality_rules.ablations(entries, policies).collect()}
    assert set(rows) == {(p.version, n) for p in policies for n in p.hard + p.soft}
    for p in policies:
        for name in p.hard + p.soft:
            row, own = rows[p.version, name], [x for x in patterns.values() if x & bit[name]]
            whole = sum(bit[n] for n in p.hard + p.soft)
            assert row.n_failed == len(own) and row.sole == sum(x & whole == bit[name] for x in own)
            assert row.kept == sum(not rejected(x, p) for x in patterns.values())
            assert row.kept_without == sum(not rejected(x & ~bit[name], p) for x in patterns.values())
            assert (row.also or 0) == (0 if not own else __import__("functools").reduce(int.__or__, own))
            assert (row.always or 0) == (0 if not own else __import__("functools").reduce(int.__and__, own))
    other = quality_rules.rejudged(entries, [Rule("many_words", "n_words > 100")])
    assert {r.id: r.failed for r in other.collect()} == {r.id: int(r.n_words > 100) for r in entries.collect()}
    none = quality_rules.ledger(empty)
    assert none.count() == 0 == quality_rules.ablations(none, policies).count() == quality_rules.decisions(none, policies).count()


# filter audit


def brute_audit(docs, labels):
    texts = [(i, t or "", s or "") for i, t, s in docs]
    smallest = {}
    for i, t, _ in texts:
        if i is not None:
            smallest[t] = min(i, smallest.get(t, i))
    good, toxic = ({i for i, q, x in labels if i is not None and (q, x)[k] == 1} for k in (0, 1))
    fails = {
        "A": lambda i, t, w: len(w) < 50, "B": lambda i, t, w: 100 * len(set(w)) < 65 * len(w),
        "C": lambda i, t, w: 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), "D": lambda i, t, w: bool(set(t) & set("#$%&*|")),
        "E": lambda i, t, w: i is not None and i > smallest[t],
    }
    parts = defaultdict(list)
    for i, t, s in texts:
        w = WORD.findall(t)
        parts[s].append(({x for x, f in fails.items() if f(i, t, w)}, i in good, i in toxic))
    out = {}
    for part, rows in parts.items():
        shapley = Counter()
        for order in itertools.permutations("ABCDE"):
            for step, letter in enumerate(order, 1):
                before, failing = set(order[: step - 1]), [r for r in rows if letter in r[0]]
                removed = [r for r in failing if not r[0] & before]
                shapley[letter] += len(removed)
                out[part, "".join(order), step] = [
                    sum(not r[0] & set(order[:step]) for r in rows), len(removed), len(failing) - len(removed),
                    sum(r[0] == {letter} for r in rows), sum(r[1] for r in removed), sum(r[2] for r in removed),
                ]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def audited(df):
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    rows = df.collect()
    out = {(r.part, r.filter_order, r.step): tuple(r[n] for n in names) for r in rows}
    assert len(out) == len(rows)
    return out


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_audit(spark, documents):
    rng, texts = random.Random(3), [*texts_of(3, 30), None, "", "One Two"]
    docs = [(rng.choice([None, *range(40)]), rng.choice(texts), rng.choice(["s", "t", "", None])) for _ in range(300)]
    docs += [docs[0]] * 5 + [(1, texts[0], "s")] * 4 + [(1, texts[1], "u")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 40, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1)]
    assert audited(filter_audit.audit(documents(docs), labels_of(spark, labels))) == brute_audit(docs, labels)


def test_audit_of_odd_tables(spark, odd, empty):
    none = labels_of(spark, [])
    docs = [(r.doc_id, r.text, r.source) for r in odd.collect()]
    assert audited(filter_audit.audit(odd, none)) == brute_audit(docs, [])
    assert filter_audit.audit(empty, none).count() == 0


def test_audit_of_other_filters(spark, documents):
    two = [filter_audit.Filter("x", F.length("text") > 3), filter_audit.Filter("y", None)]
    docs = documents([(1, "aaaa", "s"), (2, "aaaa", "s"), (3, "b", "s"), (4, "b", "s")])
    got = audited(filter_audit.audit(docs, labels_of(spark, []), two))
    assert {k[1:]: v[:4] for k, v in got.items()} == {("xy", 1): (2, 2, 0, 1), ("xy", 2): (1, 1, 1, 1), ("yx", 1): (2, 2, 0, 1), ("yx", 2): (1, 1, 1, 1)}
    assert len(got) == 2 * math.factorial(2)


# prefix trie


def brute_trie(rows):
    given = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            role, text = role or "", text or ""
            given[conv].append(((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]), (role, text)))
    own = {c: [t for _, t in sorted(x)] for c, x in given.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = own.get(c - int(math.fmod(c, 5)), [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    out = []
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(whole[c]) == len(p))))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return Counter(out)


def trie(spark, rows, block):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], CONVERSATIONS)
    out = prefix_trie.trie(*prefix_trie.rebuilt(prefix_trie.turns_of(df)), block=block)
    return Counter(map(tuple, out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()))


def conversations_of(seed, n=60, most=14):
    rng, rows = random.Random(seed), []
    for c in rng.sample(range(-20, 3 * n), n):
        length = rng.choice([1, 2, most // 2, most])
        for t in range(length):
            text = "hello" if t < 2 and rng.random() < 0.8 else rng.choice(["yes", "no", "é漢", None, "", "same", "same", "same"])
            rows.append((c, t, ("user", "bot", None)[t % 3], text))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [1, 3, 4])
def test_trie(spark, documents, block):
    rows = conversations_of(block)
    rows += rows[:7] + [(3, None, "user", "first"), (3, None, None, None), (None, 1, "user", "lost"), (7, 2, "bot", "tie"), (7, 2, "bot", "tied")]
    assert trie(spark, rows, block) == brute_trie(rows)


def test_trie_of_one_long_and_many_equal_conversations(spark, documents, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 3)
    monkeypatch.setattr(prefix_trie, "PIECE", 4)
    rows = [(1000, t, "user", f"turn {t % 7}") for t in range(90)] + [(1001, t, "user", f"turn {t % 7}") for t in range(60)]
    rows += [(c, t, "user", "hello") for c in range(40) for t in range(3)]
    assert trie(spark, rows, 4) == brute_trie(rows)


def test_trie_of_nothing(spark, documents):
    assert trie(spark, [], 4) == Counter()
    assert trie(spark, [(None, 1, "user", "x")], 4) == Counter()
    # Conversation 6 keeps nothing: its first turns would be conversation 5's, which isn't there.
    assert zlib.crc32(b"6") % 9 > 1
    assert trie(spark, [(6, 0, "user", "x")], 4) == brute_trie([(6, 0, "user", "x")])
