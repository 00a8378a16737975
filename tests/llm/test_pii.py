import hashlib
import random
import re

import __spark_entry__
from veriloom.llm.pii_bootstrap import find_personal_data


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def base(t):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [(m.start(), 0, m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end(), "card") for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [(m.start(), 3, m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(digits(m)) <= 15]
    return sorted(out)


def test_base_spans(spark):
    random.seed(3)
    bits = ["a@b.c", "@", ".", "1.2.3.4", "256.1.1.1", "001.2.3.255", "+1 (743) 555-3824", "4111 1111 1111 1111", "4111-1111-1111-1112", "_x@y.zz", "x", " ", "é", "😀", "12", "-", "+", "(", "a@b", "...", "@x.y@z.w"]
    docs = [(i, "".join(random.choice(bits) for _ in range(random.randint(0, 14)))) for i in range(1500)] + [(1500, None), (1501, "1.2.3.4 " * 700), (1502, "a@" + "b." * 5000 + "c"), (1503, "a" * 60_000)]
    got = {r["doc_id"]: [tuple(s) for s in r["base"]] for r in find_personal_data(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {i: base(t or "") for i, t in docs}


def test_bootstrap_finds_what_the_patterns_surround(spark):
    docs = [(i, f"you can call me on +1 (743) 555-38{i:02d} or later") for i in range(8)]
    docs += [(100 + i, f"you can call me on 0{i}-555{i}77 or later") for i in range(4)] + [(200, "room 4421 of the house 99881"), (201, "call me on monday")]
    got = {r["doc_id"]: [s["kind"] for s in r["spans"]] for r in find_personal_data(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert all(got[i] == ["phone"] for i in range(8)) and all(got[100 + i] == ["found_phone"] for i in range(4)) and got[200] == got[201] == []


def patterns(t, a, b):
    """Patterns around a span, by hand."""
    word = lambda x: re.sub("[0-9]", "0", x.lower())
    left, right = t[max(0, a - 64) : a], t[b : b + 40]
    left = re.sub(r"^[^\x20\x09-\x0D]+", "", left) if a > 64 else left
    right = re.sub(r"[^\x20\x09-\x0D]+$", "", right) if len(right) == 40 else right
    left, right = [word(w) for w in left.split()], [word(w) for w in right.split()]
    out = [f"L {left[-2]} {left[-1]}"] if len(left) > 1 else []
    return out + ([f"B {left[-1]} {right[0] if right else ''}"] if left else [])


def others(t, spans):
    """Identifier-like tokens that no base span touches: start, end, value."""
    out = []
    for m in re.finditer(r"[^\x20\x09-\x0D]+", t):
        if not re.search("[0-9@]", m[0]):
            continue
        a = m.start() + len(re.match("[^A-Za-z0-9@+]*", m[0])[0])
        core = t[a : m.end()]
        core = re.sub("(?<=[A-Za-z0-9])[^A-Za-z0-9]+$", "", core)
        if (len(re.sub("[0-9]", "", core)) + 4 <= len(core) or "@" in core[1:]) and not any(x < a + len(core) and a < y for x, _, y, _ in spans):
            out.append((a, a + len(core), core.lower()))
    return out


def by_hand(docs, rounds=3, support=3, trust=0.35):
    """All spans of all texts, with the graph of patterns and instances in dictionaries."""
    seeds, rest, values = {}, {}, set()
    for t in docs.values():
        spans = base(t)
        for a, _, b, kind in spans:
            values.add(t[a:b].lower())
            for p in patterns(t, a, b):
                seeds.setdefault(p, {}).setdefault(kind, set()).add(t[a:b].lower())
        for a, b, v in others(t, spans):
            for p in patterns(t, a, b):
                rest.setdefault(p, set()).add(v)
    good = {(p, k): v for p, kinds in seeds.items() for k, v in kinds.items() if len(v) >= support}
    edges = {p: rest.get(p, set()) - values for p, _ in good}
    n = {p: len(edges[p]) + len(set().union(*seeds[p].values())) for p, _ in good}
    score = {(p, k): len(v) / (n[p] + 1) for (p, k), v in good.items()}
    for _ in range(rounds):
        odds = {}
        for (p, k), c in score.items():
            if c >= trust:
                for v in edges[p]:
                    odds[v, k] = odds.get((v, k), 1.0) * (1 - c)
        score = {(p, k): (len(good[p, k]) + sum(1 - odds[v, k] for v in edges[p] if (v, k) in odds)) / (n[p] + 1) for p, k in good}
    out = {}
    for i, t in docs.items():
        spans = base(t)
        for a, b, _ in others(t, spans):
            best = max(((score[p, k], -["email", "ip", "card", "phone"].index(k), k) for p in patterns(t, a, b) for k in ("email", "ip", "card", "phone") if score.get((p, k), 0) >= trust), default=None)
            if best:
                spans = [*spans, (a, 4 - best[1], b, f"found_{best[2]}")]
        out[i] = sorted(spans)
    return out


def corpus():
    """Texts with known identifiers, held-out ones of other shapes in like contexts, and numbers that are none."""
    random.seed(13)
    filler = [f"w{c}{d}" for c in "abcdefgh" for d in "klmnop"]
    some = lambda n: " ".join(random.choice(filler).replace("w", "v", random.randint(0, 1)) for _ in range(n))
    shapes = {"phone": ("you can call me at {} any time", lambda: f"+1 (743) 555-{random.randint(1000, 9999)}", lambda: f"0{random.randint(100, 999)}-{random.randint(1000, 9999)}-{random.randint(10, 99)}"), "email": ("write a mail to {} with your name", lambda: f"{random.choice(filler)}{random.randint(1, 999)}@mail.example.com", lambda: f"{random.choice(filler)}{random.randint(1, 99)}@intranet"), "ip": ("connect to host {} on port", lambda: ".".join(str(random.randint(1, 255)) for _ in range(4)), lambda: f"fe80::{random.randint(1000, 9999)}:{random.randint(1000, 9999)}")}
    docs, held = {}, {}
    for i in range(400):
        kind = random.choice([*shapes, None, None])
        if kind is None:
            docs[i] = f"{some(8)} the year {random.randint(1900, 2030)} and room {random.randint(1000, 9999)} {some(5)}"
            continue
        text, known, unseen = shapes[kind]
        if random.random() < 0.3:
            held[i] = kind
        docs[i] = f"{some(random.randint(0, 12))} {text.format(unseen() if i in held else known())} {some(random.randint(0, 6))}"
    return docs, held


def test_found_spans_against_dictionaries_and_recall(spark):
    docs, held = corpus()
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in find_personal_data(spark.createDataFrame([*docs.items()], "doc_id long, text string")).collect()}
    assert got == by_hand(docs)
    hit = {i: [k for *_, k in got[i] if k.startswith("found_")] for i in docs}
    assert sum(hit[i] == [f"found_{k}"] for i, k in held.items()) >= 0.9 * len(held) > 20
    assert not any(hit[i] for i in docs if i not in held)


def test_query(spark, data):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    rows = __spark_entry__.queries()["op2_pii_bootstrap"](spark, data).collect()
    assert {r["doc_id"] for r in rows} == set(texts) and len(rows) == len(texts)
    for r in rows:
        spans = base(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in spans).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(x[3] == k for x in spans) for k in ("email", "ip", "card", "phone")]
        assert r["n_spans"] == len([x for x in r["spans"].split(",") if x]) and r["has_personal_data"] == (r["n_spans"] > 0)


def test_odd_rows(odd, none):
    assert find_personal_data(odd).count() == odd.count()
    assert find_personal_data(none).count() == 0
