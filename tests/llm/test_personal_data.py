import hashlib
import math
import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from kbspark.llm import personal_data as pd, queries
from tests.llm.samples import awkward, documents

KNOWN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
GAP, WORD = "\x20\x09-\x0D", "[^\x20\x09-\x0D]+"


def luhn(digits):
    doubled = [int(d) * (1 + n % 2) for n, d in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def good(kind, value):
    digits = re.sub("[^0-9]", "", value)
    return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in value.split(".")),
            "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]


def known(text):
    found = [(m.start(), n, m.end(), kind, m[0]) for n, (kind, search) in enumerate(KNOWN.items())
             for m in re.finditer(search, text) if good(kind, m[0])]
    return [(kind, start, end, value) for start, _, end, kind, value in sorted(found)]


def kinds(value):
    size, address = len(re.sub("[^0-9]", "", value)), re.search(r"@|\(at\)|\[at\]", value)
    number = not address and ":" not in value
    quad = re.fullmatch(r"[0-9]+(\.[0-9]+){3}", value)
    return [kind for kind, ok in (("email", address), ("ip", not address and (":" in value or quad)),
                                  ("card", number and 12 <= size <= 19), ("phone", number and 7 <= size <= 15)) if ok]


def instance(value):
    if re.search("[A-Za-z@:]", value):
        return value.lower()
    if re.fullmatch(r"[0-9]+(\.[0-9]+){3}", value):
        return value
    return ("+" if value[0] == "+" else "") + re.sub("[^0-9]", "", value)


def contexts(text, start, end, low, high):
    """Patterns around a match; ``low`` and ``high`` end the match before and begin the one after of the same search."""
    before, after = text[low:start], text[end:high]
    left = re.sub(f"^{WORD}", "", before[-pd.CONTEXT:]) if len(before) > pd.CONTEXT else before
    right = re.sub(f"{WORD}$", "", after[:pd.CONTEXT]) if len(after) > pd.CONTEXT else after
    left = re.findall(WORD, re.sub(f"{WORD}$", "", left).lower())
    right = re.findall(WORD, re.sub(f"^{WORD}", "", right).lower())
    out = [f"L {left[-2]} {left[-1]}"] if len(left) > 1 else []
    out += [f"M {left[-1]} {right[0]}"] if left and right else []
    return out + ([f"R {right[0]} {right[1]}"] if len(right) > 1 else [])


def searched(search, text):
    matches = list(re.finditer(search, text))
    for n, m in enumerate(matches):
        yield m[0], m.start(), m.end(), contexts(
            text, m.start(), m.end(), matches[n - 1].end() if n else 0, matches[n + 1].start() if n + 1 < len(matches) else len(text))


def slow(rows):
    texts = {text or "" for _, text in rows}
    edges, open_spans = defaultdict(set), defaultdict(list)
    wide = pd.WIDE.replace(r"(?:\G|(?<![A-Za-z0-9._%+-]))", "", 1)
    for text in texts:
        base = known(text)
        for kind, search in KNOWN.items():
            for value, _, _, patterns in searched(search, text):
                if good(kind, value):
                    for pattern in patterns:
                        edges[pattern].add((instance(value), kind, True))
        for value, start, end, patterns in searched(wide, text):
            if kinds(value) and not any(b[1] < end and start < b[2] for b in base):
                open_spans[text].append((value, start, end))
                for pattern in patterns:
                    edges[pattern] |= {(instance(value), kind, False) for kind in kinds(value)}
    edges = {p: e for p, e in edges.items() if len({i for i, _, _ in e}) >= pd.SUPPORT}
    ordinary = defaultdict(set)
    for text in texts:
        words = re.findall(WORD, text.lower())
        for a, b, c in zip(words, words[1:], words[2:]):
            for pattern, filler in ((f"L {a} {b}", c), (f"M {a} {c}", b), (f"R {b} {c}", a)):
                if pattern in edges and not re.search("[0-9@]", filler):
                    ordinary[pattern].add(filler)
    scores = {}
    for _ in range(pd.ROUNDS):
        trust = {}
        for pattern, e in edges.items():
            seeds = sum(seed for _, _, seed in e)
            for kind in {k for _, k, _ in e}:
                own = sum(seed for _, k, seed in e if k == kind)
                weight = own + sum(scores.get((i, k), 0) for i, k, seed in e if k == kind and not seed)
                sure = weight / (weight + seeds - own + len(ordinary[pattern]) + 1)
                if sure >= pd.CONFIDENCE:
                    trust[pattern, kind] = sure
        doubt = defaultdict(float)
        for pattern, e in edges.items():
            for i, k, seed in e:
                if not seed and (pattern, k) in trust:
                    doubt[i, k] += math.log(1 - trust[pattern, k])
        scores = {key: 1 - math.exp(value) for key, value in doubt.items()}
    best = {}
    for (i, k), score in sorted(scores.items(), key=lambda s: (round(s[1], 9), -pd.KINDS.index(s[0][1]))):
        best[i] = k
    out = {}
    for text in texts:
        spans = [(*s, True) for s in known(text)]
        spans += [(best[instance(v)], start, end, v, False) for v, start, end in open_spans[text] if instance(v) in best]
        out[text] = sorted(spans, key=lambda s: (s[1], pd.KINDS.index(s[0])))
    return out


def check(spark, rows):
    table = documents(spark, rows)
    marked = pd.with_spans(table, "hits")
    assert marked.columns == [*table.columns, "hits"]
    wanted = slow(rows)
    got = sorted(((r["doc_id"], r["text"], [tuple(s) for s in r["hits"]]) for r in marked.collect()), key=repr)
    assert got == sorted(((key, text, wanted[text or ""]) for key, text in rows), key=repr)
    return wanted


EDGES = [
    "a@b.c_d@e.f a@b.c.d@e.f x@y @z.q a.@.b .@b-.c", "1.2.3.4.5.6.7.8 1.2.3 2.3.4.5. 256.1.1.1 001.2.3.255",
    "4111 1111 1111 1111 4111-1111-1111-1111 4111  1111 1111 1112 12 3 4-5", "+1 (017) 555-7713, +49-170 1234567. +1 +2 333 +123456789012345678",
    "𝄞 é mail: Ä.b@c.de, +1 (017) 555-77133 ß 9807915762804490", "a" * 30_000 + "@b.c", "a@" + "b." * 20_000 + "c",
    "1." * 20_000 + "1", "1 " * 20_000, "+1" + " " * 20_000 + "1" * 9, "(" * 5000 + "1" + ")" * 5000]


def test_known_forms_and_edges(spark):
    check(spark, [(n, text) for n, text in enumerate(EDGES)] + awkward())


def contextual(seed):
    chance = random.Random(seed)
    words = ["".join(chance.choices("abcdefg", k=3)) for _ in range(40)]

    def some(n):
        return " ".join(chance.choices(words, k=n))

    def phone():
        return f"+1 ({chance.randint(100, 999)}) 555-{chance.randint(1000, 9999)}"

    def bare():
        return f"{chance.randint(100, 999)}-555-{chance.randint(1000, 9999)}"

    rows = [f"{some(3)} call me at {phone()} {some(4)}" for _ in range(6)]
    rows += [f"{some(3)} call me at {bare()} {some(4)}" for _ in range(4)]
    rows += [f"{some(2)} write to user{n}@mail.example.com now please {some(2)}" for n in range(6)]
    hidden = [f"person{n}@intranet" for n in range(5)]
    rows += [f"Write TO {name} now please" for name in hidden]
    # A pattern without seeds, learnt from what another one found.
    rows += [f"{some(2)} inbox of {name} is full" for name in hidden] + [f"{some(1)} inbox of stranger@host is full {some(3)}"]
    # A common context: identifiers are few among its words.
    rows += [f"{some(2)} of the {word} {some(2)}" for word in words] + [f"of the {phone()} {some(1)}" for _ in range(4)]
    rows += [f"{some(1)} of the 5551234567 {some(2)}", f"order 99887766 {some(3)}"]
    # A pattern of two kinds.
    rows += [f"id is {phone()} ok" for _ in range(3)] + [f"id is 10.0.0.{n} ok" for n in range(3)] + ["id is 5557654321 ok"]
    return [(n, text) for n, text in enumerate(rows)]


def test_contexts_find_unseen_identifiers(spark):
    rows = contextual(1)
    wanted = check(spark, rows + rows[:5] + awkward())
    added = [s[3] for spans in wanted.values() for s in spans if not s[4]]
    assert "person3@intranet" in added and "stranger@host" in added
    assert len([value for value in added if "-555-" in value]) == 4
    assert not {"5551234567", "99887766", "5557654321"} & set(added)


def test_patterns_beyond_the_broadcast_bound(spark):
    spark.conf.set("kbspark.maxBroadcastBytes", "0")
    try:
        check(spark, contextual(2))
    finally:
        spark.conf.unset("kbspark.maxBroadcastBytes")


def test_empty_table(spark):
    assert pd.with_spans(documents(spark, []), "hits").collect() == []


def test_plan_is_native(spark):
    plan = pd.with_spans(documents(spark, awkward()), "hits")._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    given = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    wanted = slow(given)
    rows = {row["doc_id"]: row for row in queries.op12_personal_data(spark, sf).collect()}
    assert len(rows) == len(given)
    for key, text in given:
        base = known(text or "")
        row = rows[key]
        assert [row[f"n_{kind}"] for kind in KNOWN] == [sum(s[0] == kind for s in base) for kind in KNOWN]
        assert row["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b, _ in base).encode()).hexdigest()
        assert row["spans"] == ",".join(f"{k}:{a}:{b}" for k, a, b, _, _ in wanted[text or ""])
