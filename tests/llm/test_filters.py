import random
import re
from collections import Counter

import pytest

from docquarry.llm.license_texts import LICENSE_TEXTS
from docquarry.llm.licenses import PHRASES, TEMPLATES, scan_licenses, template_table
from docquarry.llm.quality import apply_quality_rules
from docquarry.llm.urls import BLOCK_GLOBS, HOST_END, RULES, HostRule, ShiftAnd, filter_urls

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def glob_regex(glob):
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            run = re.match(r"\*+", glob[i:])[0]
            out += ".*" if len(run) > 1 else "[^/\\x00]*"
            i += len(run)
            continue
        if c == "\\":
            i += 1
            c = glob[i]
            out += re.escape(c)
        else:
            out += "." if c == "?" else re.escape(c)
        i += 1
    return re.compile(out, re.S)


def test_shift_and_equals_regex():
    rng = random.Random(5)
    globs = ["".join(rng.choices(["a", "b", "/", "*", "**", "?", "\\*"], k=rng.randrange(0, 40))) for _ in range(40)]
    texts = ["".join(rng.choices("ab/*", k=rng.randrange(0, 50))) for _ in range(300)] + ["", "a" * 3000]
    machine = ShiftAnd(globs)
    assert machine.words > 3
    got = machine.match([t.encode() for t in texts])
    for i, t in enumerate(texts):
        assert got[i].tolist() == [bool(glob_regex(g).fullmatch(t)) for g in globs], t


def judge(url, rules=RULES, globs=BLOCK_GLOBS):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?", url or "")
    host = "".join(c.lower() if c < "\x80" else c for c in m[1]) if m else ""
    path, query = (m[2], m[3] or "") if m else ("", "")
    fit = [r for r in rules if ("." + host).endswith("." + r.host) and path.startswith(r.path)]
    if fit:
        best = max(fit, key=lambda r: len(r.name))
        return host, path, best.name, best.verdict
    no_nul = lambda x: x.replace("\x00", "\x01")
    whole, marked = no_nul("." + host + path + query), "." + no_nul(host) + HOST_END + no_nul(path + query)
    return host, path, None, "block" if any(glob_regex(g).fullmatch(marked if HOST_END in g else whole) for g in globs) else "allow"


URLS = [
    None, "", "no scheme", "http://", "http://org", "http://org/", "http://ORG/x", "https://a.example.org/es/1", "https://example.org/en/12?x=/es/",
    "https://badexample.org/es/1", "https://x.com/fr/1#a", "https://x.com/de/1", "https://com/de/", "https://x.net/.org/a", "https://x.net/com/de/",
    "ftp://x.net/a.exe", "http://x.net/?phpsessid=1", "http://x.net/a/wp-admin/b", "http://x.net?q=://y.org/es/", "http://ÀB.org/é", "x://y://z.org/es/", "http://x.net/" + "a/" * 20000 + "b.zip",
    "http://x.net/a\nb.zip", "http://x.com/de/", "http://x.com/de/", "http://foo.net?x=a.org/", "http://foo.net?u=x.com/de/", "http://x.org?u=a.com/de/",
    "http://foo.net#a.org/", "http://a\x00.org/b\x00.com/de/", "http://my-casino.net", "http://x.net/casino", "http://x.net?casino/a", "http://free-bets.x.com?q=1",
]


def test_urls_equal_plain_rules(spark):
    rows = [(i, u, "h", "r") for i, u in enumerate(URLS)]
    got = filter_urls(spark.createDataFrame(rows, "page_id long, url string, HOST string, rule string")).collect()
    assert {(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in got} == {(i, *judge(u)) for i, u in enumerate(URLS)}
    assert len(got) == len(URLS)
    assert filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_thousands_of_globs_and_rules(spark):
    rng = random.Random(3)
    name = lambda: "".join(rng.choices("abc", k=3))
    rules = [HostRule(rng.choice(["allow", "block"]), f"{name()}.{name()}", f"/{name()[:k]}") for k in (0, 1, 2) for _ in range(200)]
    rules = list({r.name: r for r in rules}.values())
    globs = [f"**/{name()}{name()}**" for _ in range(1500)] + [f"*{name()}?.*{HOST_END}**" for _ in range(500)]
    urls = [f"http://{name()}.{name()}.{name()}{rng.choice(['', '/', '/' + name() + name() + name(), '?/' + name() + name()])}" for _ in range(300)]
    got = filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules=rules, block_globs=globs).collect()
    assert {(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in got} == {(i, *judge(u, rules, globs)) for i, u in enumerate(urls)}
    assert {r["verdict"] for r in got if r["rule"] is None} == {"allow", "block"}


def counters(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times = Counter(windows)
    again = {i for i, w in enumerate(windows) if times[w] > 1}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines), len(lines) - len(set(lines)),
        sum(any(j in again for j in range(i - 4, i + 1)) for i in range(len(words))),
    )


def quality_texts():
    rng = random.Random(2)
    texts = [None, "", " \n ", "a b c d e", "a b c d e f a b c d e", "x x x x x x x x x x x x", "a\na\nb\n \n \na", "é ü 😀 # * $\x0bq", "one " * 500]
    texts += [" ".join(rng.choices("abcd", k=rng.randrange(60))).replace("a b", "a\nb") for _ in range(60)]
    return texts + [" ".join(f"w{i % 700}" for i in range(5000)), *texts[3:9]]


def test_quality_counters_and_hosts(spark):
    texts = quality_texts()
    rows = [(i, t, None if i % 7 == 0 else f"s{i % 3}", False, 1) for i, t in enumerate(texts)]
    got = apply_quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string, kept boolean, n_words int")).collect()
    assert len(got) == len(texts)
    hosts = {}
    for r in got:
        n, chars, symbols, lines, dup, repeat = counters(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_lines"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, lines, dup, repeat)
        assert r["base_failed"] == (n < 10 or 100 * repeat > 20 * n)
        failed = r["base_failed"] or 100 * symbols > 10 * chars or 100 * dup > 30 * lines
        assert r["rules_failed"] == failed
        hosts.setdefault(r["source"], []).append(failed)
    n, k = sum(map(len, hosts.values())), sum(map(sum, hosts.values()))
    m = k / n
    between = sum(sum(h) ** 2 / len(h) for h in hosts.values()) / n - m * m - m * (1 - m) * len(hosts) / n
    s = max(1.0, min(10000.0, m * (1 - m) / between - 1)) if between > 0 else 10000.0
    for r in got:
        h = hosts[r["source"]]
        rate = (sum(h) + s * m) / (len(h) + s)
        assert r["host_rate"] == pytest.approx(rate, abs=1e-8)
        assert r["kept"] == (not r["base_failed"] and not rate > 0.5)
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert apply_quality_rules(empty).count() == 0


def plain_blocks(words, templates=TEMPLATES + LICENSE_TEXTS):
    """All blocks of every template, tried at every word."""
    labels, score = set(), 0.0
    for label, text in templates:
        t = WORD.findall(text.lower())
        width, distinct = int(1.5 * len(t)), set(t)
        for s in range(len(words)):
            c = len(distinct & set(words[s : s + width])) / len(distinct)
            if c >= 0.9:
                labels.add(label)
                score = max(score, c)
    return labels, score


def license_texts():
    rng = random.Random(4)
    pool = [w for _, t in TEMPLATES for w in t.split()] + ["foo", "bar", "É", "1x"]
    texts = [None, "", "...", "CC BY cc-by cc by", "All Rights\nReserved. all rights reserved all rights", "General Public License"]
    for label, t in TEMPLATES:
        w = t.split()
        w[rng.randrange(len(w))] = "zzz"
        texts += [f"x {t.upper()} y", " ".join(w), " foo ".join(t.split())]
    texts += [" ".join(rng.choices(pool, k=rng.randrange(5, 80))) for _ in range(40)]
    for _, t in LICENSE_TEXTS:
        texts += [f"Copyright (c) 2020 X. All rights reserved.\n{t}", t.replace("the", "a"), t[: len(t) // 2]]
    return texts + [TEMPLATES[0][1], "\u212a " + "a" * 100000]


def test_licenses_equal_all_blocks(spark):
    texts = license_texts()
    rows = [(i, t, "l") for i, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string, labels string")).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        low = "".join(c.lower() if c < "\x80" else c for c in text or "")
        words, r = WORD.findall(low), got[i]
        places = [(s, label) for p, label in PHRASES for s in range(len(words)) if words[s : s + len(p.split())] == p.split()]
        labels, score = plain_blocks(words)
        assert (r["n_words"], r["n_base"]) == (len(words), len(places))
        assert (r["first_word"], r["last_word"]) == (min((s for s, _ in places), default=None), max((s for s, _ in places), default=None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places}))
        assert r["labels"] == ",".join(sorted({x for _, x in places} | labels))
        assert r["score"] == pytest.approx(max([1.0] if places else [score]) if places or labels else 0.0)
    assert scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_every_block_is_there_if_asked_for(spark):
    words = "x y released under the mit license z released under the mit license under the mit".split()
    frame = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
    template = "released under the mit license".split()
    want = []
    for s, w in enumerate(words):
        inside = [j for j in range(s, min(len(words), s + 7)) if words[j] in template]
        if w in template and len({words[j] for j in inside}) == 5:
            want.append(("mit", s, inside[-1] + 1))
    got = scan_licenses(frame, phrases=(), templates=(("mit", " ".join(template)),), every_block=True).first()["blocks"]
    assert [tuple(b)[:3] for b in got] == want and len(want) > 2
    kept = scan_licenses(frame, phrases=(), templates=(("mit", " ".join(template)),)).first()["blocks"]
    assert {tuple(b)[:3] for b in kept} < set(want)


def test_hundreds_of_templates_from_a_table(spark):
    rng = random.Random(6)
    words = [f"term{i}" for i in range(400)] + ["the", "of", "and"] * 20
    licenses = [(f"l{i}", " ".join(rng.choices(words, k=rng.randrange(8, 60)))) for i in range(300)]
    table = spark.createDataFrame([*licenses, (None, "x"), ("y", None), licenses[0]], "label string, text string")
    templates = template_table(table)
    assert templates == sorted(licenses)
    with pytest.raises(ValueError, match="more than 10"):
        template_table(table, most=10)
    with pytest.raises(ValueError, match="more than 100 bytes"):
        template_table(table, most_bytes=100)
    texts = []
    for i in range(60):
        body = rng.choice(licenses)[1].split()
        for _ in range(rng.randrange(4)):
            body[rng.randrange(len(body))] = "other"
        texts.append(" ".join([*rng.choices(words, k=rng.randrange(60)), *body, *rng.choices(words, k=rng.randrange(60))]))
    texts += texts[:2]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in scan_licenses(rows, phrases=(), templates=templates).collect():
        labels, score = plain_blocks(WORD.findall(texts[r["doc_id"]]), licenses)
        assert r["labels"] == ",".join(sorted(labels)) and r["score"] == pytest.approx(score)
        assert {b["label"] for b in r["blocks"]} == labels
