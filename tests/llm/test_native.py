import hashlib
import re
from collections import Counter, defaultdict

from tierblend.llm import decontaminate, secrets

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, sig string, ws string, item_id string"
ITEM = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"


def brute(text, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: re.sub("[A-Z]", lambda m: m.group().lower(), t or "")
    ws, hit, owners = word.findall(low(text)), set(), set()
    for key, body in items:
        iw = word.findall(low(body))
        n = min(13, len(iw))
        windows = {tuple(iw[i:i + n]) for i in range(len(iw) - n + 1)} if n else set()
        for i in range(len(ws) - n + 1):
            if tuple(ws[i:i + n]) in windows:
                hit |= set(range(i, i + n))
                owners.add(str(key))
    ids = hashlib.sha256(",".join(sorted(owners)).encode()).hexdigest()
    return len(ws), len(hit), len(owners), ids, bool(hit) and 20 * len(hit) >= len(ws)


def digest(hits):
    F = decontaminate.F
    return [tuple(r) for r in decontaminate.judge(hits).select(
        "doc_id", "n_words", "n_hit", F.size("item_ids"), F.sha2(F.array_join("item_ids", ","), 256),
        "contaminated").collect()]


def test_windows_equal_brute_force(spark):
    items = [(1, ITEM), (2, "Alpha, beta"), (10, "solo"), (3, None), (4, "..."), (5, ITEM.upper() + " sixteen"), (5, "solo")]
    texts = [None, "", ITEM, "x " * 400 + ITEM, "x " * 40 + ITEM.replace("two", "2"), "a alpha beta b solo", "é",
             " ".join(ITEM.split()[1:14]), "clean words only here", ITEM, "solo " * 50, "y " * 30_000 + ITEM]
    docs = [(i if i % 4 else None, t) for i, t in enumerate(texts)] + [(1, "other text"), (1, "solo")]
    df = spark.createDataFrame([(i, t) + (None,) * 6 for i, t in docs], SCHEMA)
    side = spark.createDataFrame([(k, t, "clash") for k, t in items], "item_id long, text string, doc_id string")
    got = digest(decontaminate.find_hits(df, side))
    assert Counter(got) == Counter((i, *brute(t, items)) for i, t in docs)
    kept = decontaminate.drop_contaminated(df, side)
    assert kept.columns == df.columns
    assert Counter(r.text for r in kept.collect()) == Counter(t for _, t in docs if not brute(t, items)[-1])
    assert decontaminate.find_hits(df.where("false"), side).count() == 0
    assert all(r.n_hit == 0 for r in decontaminate.find_hits(df, side.where("false")).collect())


def base(text):
    out = []
    text = text or ""
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                        re.I | re.A)
    for rank, (kind, rx, g, least) in enumerate([("assign", assign, 2, 6), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20),
                                                 ("hex", re.compile("[0-9a-f]+"), 0, 24)]):
        out += [(m.start(), rank, f"{kind}:{m.start()}:{m.end()}") for m in rx.finditer(text) if len(m.group(g)) >= least]
    return ",".join(x[2] for x in sorted(out))


def test_spans_and_redaction(spark):
    key, hexa = "AKIA" + "Q7" * 9, "0123456789abcdef" * 2
    texts = [None, "", "none here", f"a \U0001f600é {key} b", f"Password = '{hexa}' x", "secret=token : abcdefgh",
             "token=abc api_key: zyxwvut passwd='q1w2e3r4'", f"{key}{key} {hexa}g{hexa}", "AKIAAKIA" + "A1" * 9,
             "x " * 50_000 + f"SECRET:{key}", "opaque Ab1" + "cD2" * 12 + " end", f"{hexa}", f"{hexa}"]
    rows = [(i // 2 if i else None, t, None, f"s{i}" if i < 10 else None, 1, "c", "c", "c") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = defaultdict(list)
    for r in secrets.scan(df).collect():
        got[r.doc_id].append(",".join(f"{s.kind}:{s.start}:{s.end}" for s in r.spans if s.rank < 3))
    want = defaultdict(list)
    for r in rows:
        want[r[0]].append(base(r[1]))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    spans = {r.doc_id: r for r in secrets.scan(df.where("text like 'opaque%'")).collect()}
    assert [s.kind for s in spans[5].spans] == ["opaque"]
    clean = secrets.redact(df)
    assert clean.columns == df.columns and clean.count() == len(rows)
    for r in clean.collect():
        assert base(r.text) == "" and key not in (r.text or "")
    assert sum(r.text is None for r in clean.collect()) == 1
    assert secrets.scan(df.where("false")).count() == 0


def test_ownership_counts(spark):
    rows = [(i, "token=samplekey", "en", f"s{i}", 1, "", "", "") for i in range(6)] + [(9, "token=onlymine", "en", "s1", 1, "", "", "")]
    live = {r.doc_id: r.spans[0].live for r in secrets.scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert live == {**{i: False for i in range(6)}, 9: True}


def test_opaque_values_behind_and_before_equals_signs(spark):
    key, more = "aB3" + "dE5fG7" * 6, "Zy9" + "xW8vU6" * 6
    texts = [f"AWS_SECRET_ACCESS_KEY={key}", f"GET /x?sig={key}&t=1", f"blob {key}== end", f"env={key}=\n", f"'{key}='",
             f"{key}={more}"]
    rows = [(i, t, "en", "s", 1, "", "", "") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: [texts[r.doc_id][s.start:s.end] for s in r.spans] for r in secrets.scan(df).collect()}
    assert got == {0: [key], 1: [key], 2: [key + "=="], 3: [key + "="], 4: [key + "="], 5: [more]}
    assert all(more not in r.text and (r.doc_id == 5 or key not in r.text) for r in secrets.redact(df).collect())
