import hashlib
import random
import re

from pyspark.sql import functions as F

from docloom.llm import secrets
from tests.llm import samples

ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
CANDIDATE = re.compile(r"[A-Za-z0-9_-]{20,}")


def base(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


def values(text):
    text = text or ""
    for start, kind, end in base(text):
        yield start, kind, end, ASSIGN.match(text, start)[2] if kind == 0 else text[start:end]
    for m in CANDIDATE.finditer(text):
        if all(re.search(p, m[0]) for p in ("[0-9]", "[a-z]", "[A-Z]")):
            yield m.start(), 3, m.end(), m[0]


def rows():
    rng = random.Random(3)
    out = samples.texts()
    alphabet = "abcdefABCDEF0123456789"
    kept = ["".join(rng.choice(alphabet) for _ in range(24)) for _ in range(6)]
    bits = ["password", "API_KEY", "apikey", "Token", "secret", ":", "=", " = ", "'", '"', " ", "é", "日", "\n", "AKIA", "AKIAABCDEFGH1234", "0" * 31, "f" * 32, "abcdefgh", "x", *kept]
    for i in range(400):
        out.append((5000 + i, "".join(rng.choice(bits) for _ in range(rng.randint(1, 30))), rng.choice(["en", "fr"]), rng.choice(["s1", "s2", "s3", None])))
    out += [(6000, "secret: token: abcdefgh12 token=password=abcdefgh123", "en", "s1"), (6001, "token=" + "A1b2" * 10, "en", "s9")]
    out += [(6002, " ".join(f"token=abcdefgh{i}" for i in range(3000)), "en", "s9")]
    return out


def test_spans_and_ownership(spark):
    data = rows()
    owners, places = {}, {}
    for _, text, lang, source in data:
        for *_, value in values(text):
            owners.setdefault(value, set()).add(source)
            places.setdefault(value, set()).add((source, lang))
    want = []
    for doc, text, *_ in data:
        spans = []
        for start, kind, end, value in values(text):
            live = len(owners[value]) <= 1 and len(places[value]) <= 2
            if kind < 3 or live:
                spans.append((start, kind, end, value, len(owners[value]), live))
        want.append((doc, tuple(sorted(spans))))
    found = secrets.scan(samples.frame(spark, data))
    got = [(r.doc_id, tuple((s.start, s.kind, s.end, s.value, s.n_owners, s.live) for s in r.spans)) for r in found.collect()]
    samples.same(got, want)


def test_listing(spark):
    data = rows()
    found = secrets.scan(samples.frame(spark, data))
    listed = found.select("doc_id", F.sha2(secrets.listed(F.filter("spans", lambda s: s["kind"] < 3)), 256).alias("h"))
    names = ("assign", "access", "hex")
    want = [(d, hashlib.sha256(",".join(f"{names[k]}:{a}:{b}" for a, k, b in base(t)).encode()).hexdigest()) for d, t, *_ in data]
    samples.same(listed.collect(), want)


def test_widely_copied_value_is_no_live_credential(spark):
    value = "Zx9" + "aB3dE6fG9h" * 2
    copied = [(i, f"see {value}", "en", f"s{i % 5}") for i in range(50)] + [(99, "see " + value[::-1], "en", "s1")]
    found = {r.doc_id: r.spans for r in secrets.scan(samples.frame(spark, copied)).collect()}
    assert not found[0] and found[99][0].live


def test_empty(spark):
    assert secrets.scan(samples.empty(spark)).count() == 0
