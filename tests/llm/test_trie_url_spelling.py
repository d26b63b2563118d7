"""Conversation trie, URL filter and spelling variants against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest

from setgraph.llm import prefix_trie, spelling, url_filter

# -- conversation trie --------------------------------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string"


def trie_by_hand(rows):
    """The contract of op11, conversation by conversation."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [t[1:] for t in sorted(turns)] for c, turns in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole = tuple(own.get(c - c % 5, [])[:h] + turns[h:])
        ends[whole].append(c)
        for d in range(len(whole) + 1):
            members[whole[:d]].append(c)
    children = Counter(node[:-1] for node in members if node)
    out = {}
    for node, convs in members.items():
        below = [x for x in members if x[: len(node)] == node]
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in below if x)
        leaves = sum(not children[x] for x in below)
        digest = hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest()
        out[min(convs), len(node)] = (min(members[node[:-1]]) if node else None, len(convs), children[node], leaves, saved, digest)
    return out


def trie_of(spark, rows):
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], TURNS + ", node string, k int")
    found = prefix_trie.prefix_trie(prefix_trie.with_shared_heads(prefix_trie.turns_in_order(frame))).collect()
    assert len({(r.conv_id, r.depth) for r in found}) == len(found)
    return {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in found}


@pytest.mark.parametrize("seed", [1, 2])
def test_trie(spark, seed, monkeypatch):
    """Shared beginnings, copies, null parts, repeated rows, ties of turns, missing bases and bases that are too short."""
    rng = random.Random(seed)
    monkeypatch.setattr(prefix_trie, "BLOCK", 16)  # many blocks of the prefix sums
    monkeypatch.setattr(prefix_trie, "STRETCH", 3)
    rows = []
    for c in rng.sample(range(150), 90):
        for turn in range(rng.choice([0, 1, 2, 3, 5, 9, 12])):
            rows.append((c, rng.choice([turn, turn, turn, None, 0]), rng.choice(["user", "assistant", None]), rng.choice(["a", "é", "", None, "bb"])))
    rows += rng.sample(rows, 20) + [(None, 1, "user", "lost")]
    rows += [(c, t, "user", f"same {t}") for c in range(200, 260) for t in range(4)]
    assert trie_of(spark, rows) == trie_by_hand(rows)


def test_trie_edges(spark):
    """No rows, no rows with an id, and one long conversation with a text of many bytes."""
    assert trie_of(spark, []) == {}
    assert trie_of(spark, [(None, 1, "user", "x")]) == {}
    rows = [(3, t, "user", "x" * (100_000 if t == 40 else t)) for t in range(50)]
    assert trie_of(spark, rows) == trie_by_hand(rows)


def test_turnless_conversation(spark):
    """A conversation whose turns all fall to a base that isn't there is a member of the root alone."""
    c = next(c for c in range(1, 100) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 2)
    found = trie_of(spark, [(c, 0, "user", "x")])
    assert found == {(c, 0): (None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())}


def test_prefix_sums(spark):
    rng = random.Random(3)
    at = sorted(rng.sample(range(400_000), 500))
    values = [rng.randint(0, 9) for _ in at]
    found = prefix_trie.prefix_sums(spark.createDataFrame(list(zip(at, values, strict=True)), "at long, v long"), "at", "v").collect()
    assert {r.at: r.upto_v for r in found} == {a: sum(values[: i + 1]) for i, a in enumerate(at)}


# -- URL filter ---------------------------------------------------------------------------------------------------

PAGES = "page_id long, url string, host string, verdict string, n long"


def verdicts_by_hand(urls, rules, listed=()):
    def cut(url):
        rest = (url or "").partition("://")[2]
        ends = [i for i, c in enumerate(rest) if c in "/?#"] + [len(rest)]
        host, tail = rest[: ends[0]], rest[ends[0] :]
        stops = [i for i, c in enumerate(tail) if c in "?#"] + [len(tail)]
        return "".join(c.lower() if c.isascii() else c for c in host), tail[: stops[0]], tail[stops[0] :]

    def canonical(url):
        host, path, tail = cut(url)
        bare = host.rsplit("@", 1)[-1]
        name, colon, port = bare.rpartition(":")
        bare = (name if colon and all(c in "0123456789" for c in port) else bare).rstrip(".")
        query = tail[1:].partition("#")[0] if tail.startswith("?") else ""
        first, *rest = query.split("&")
        dropped = ("ref=", "fbclid=", "gclid=")
        kept = [p for p in (first, *rest) if not p.startswith(dropped) and not (p.startswith("utm_") and "=" in p and p[4:].partition("=")[0].isalpha())]
        return bare + (path or "/") + ("?" + "&".join(kept) if "".join(kept) else "") if bare else None

    out = {}
    for url in urls:
        host, path, _ = cut(url)
        fit = [(len(h + p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        out[url] = (host, path, *(max(fit)[2:] if fit else (None, None)), canonical(url))
    blocked = {x[4] for x in out.values() if x[3] == "block"} | set(listed)
    return {u: (h, p, r, v or ("block" if c in blocked and c else "allow"), c) for u, (h, p, r, v, c) in out.items()}


URLS = [
    "http://example.com/en/1", "https://WWW.Example.com/en/1?ref=x", "http://blog.www.example.com/en/", "http://example.com", "http://example.com/",
    "http://notexample.com/en/1", "http://a.example.com/en", "http://x.net/es/", "http://x.net/es", "http://net/fr/2#top", "http://x.net/de/1?utm_source=feed",
    "http://x.org/?a=1&ref=2&b=3", "http://x.org?ref=2", "ftp://x.org#f", "://", "x", "", None, "http://.com/1", "http://example.com./en/1", "http://u:p@example.com/en/1",
    "http://example.com:80/en/1", "http://EXAMPLE.com:8080/en/1?gclid=7#a", "http://x.net:81/es/", "http://x.net/es/?utm_medium=m", "http://É.example.com/en/ü", "a://b://c.com/x",
    "http://x.net\n/es/", "http://x.org/" + "a" * 50_000, "http://" + "a." * 20_000 + "net/es/", "http://?x.com/",
]


def judged(spark, urls, rules=url_filter.RULES, listed=None):
    pages = spark.createDataFrame([(i, u, "h", "v", 1) for i, u in enumerate(urls)], PAGES)
    rules = spark.createDataFrame(rules, "verdict string, host string, path string")
    listed = None if listed is None else spark.createDataFrame([(x,) for x in listed], "canonical string")
    found = url_filter.judge_urls(pages, rules, listed).collect()
    assert sorted(r.page_id for r in found) == list(range(len(urls)))
    return [(urls[r.page_id], (r.host, r.path, r.rule, r.verdict, r.canonical)) for r in found]


def test_urls(spark):
    """Every kind of URL, repeated; disguised ones of a blocked page are blocked by the list."""
    known = verdicts_by_hand(URLS, url_filter.RULES)
    found = judged(spark, URLS * 3)
    assert all(known[u] == x for u, x in found)
    by_list = {u for u, x in found if x[2] is None and x[3] == "block"}
    assert {"http://example.com./en/1", "http://example.com:80/en/1", "http://x.net:81/es/"} <= by_list


@pytest.mark.parametrize("seed", [1, 2])
def test_many_rules(spark, seed, monkeypatch):
    """Rules and a list of any shape, with filter and hits shuffled and keys dealt as hot ones."""
    rng = random.Random(seed)
    monkeypatch.setattr(url_filter, "MOST_BLOCKS", 0)
    monkeypatch.setattr(url_filter, "MOST_SENT", 0)
    monkeypatch.setattr("setgraph.llm.common.LEAST_HOT", 20)
    name = lambda: ".".join(rng.choice("abc") for _ in range(rng.randint(1, 4)))
    path = lambda: "".join(rng.choice(["/", "/x", "y", "é"]) for _ in range(rng.randint(0, 3)))
    rules = list({(h, p): (rng.choice(["allow", "block"]), h, p) for h, p in ((name(), "/" + path()) for _ in range(30))}.values())
    urls = [f"http://{name()}{rng.choice(['', ':80', '.'])}/{path()}" for _ in range(400)]
    listed = [u.partition("://")[2].replace(":80", "") for u in urls[:40]]
    known = verdicts_by_hand(urls, rules, listed)
    assert all(known[u] == x for u, x in judged(spark, urls, rules, listed))


def test_no_pages_or_rules(spark):
    assert judged(spark, []) == []
    assert [x[1][3] for x in judged(spark, ["http://a.com/"], [])] == ["allow"]
    assert [x[1][3] for x in judged(spark, ["http://a.com/?ref=1"], [], ["a.com/", None])] == ["block"]


def test_bloom_filter(spark):
    """All listed keys pass, few others do."""
    keys = spark.range(40_000).selectExpr("concat('key ', id) AS key", "id")
    listed = keys.filter("id % 4 = 0").select("key")
    passed = {r.id for r in url_filter.possible_hits(keys, listed, 10_000).collect()}
    assert {i for i in range(40_000) if i % 4 == 0} <= passed
    assert len(passed) - 10_000 < 0.005 * 30_000
    assert url_filter.listed_hits(keys, listed).count() == 10_000


# -- spelling variants --------------------------------------------------------------------------------------------

DOCS = "doc_id long, text string, word string, n long, key long"


def words_by_hand(rows):
    counts = Counter()
    letter = lambda c: c.isascii() and c.isalpha() or "\u00c0" <= c <= "\u00ff"
    for doc_id, text in rows:
        runs, run = [], ""
        for c in (text or "") + " ":
            if letter(c):
                run += c.lower() if c.isascii() else c
            elif run:
                runs.append(run)
                run = ""
        for run in runs:
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += len(run) >= 7
    return {w: n for w, n in counts.items() if n >= 2}


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    same = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[same + (len(a) == len(b)) :] == b[same + 1 :]


def variants_by_hand(words):
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {w: (form[w], root(w), words[w], len(near[w]), form[w] and words[form[w]]) for w in words}


def variants(found):
    found = found.collect()
    assert len({r.word for r in found}) == len(found)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in found}


@pytest.mark.parametrize("seed", [1, 2])
def test_variants(spark, seed, monkeypatch):
    """Words of few letters, so that many are near; frequent ones, so that forms follow forms."""
    rng = random.Random(seed)
    monkeypatch.setattr(spelling, "PART_KEYS", 100)
    words = {"".join(rng.choice("abÿ") for _ in range(rng.choice([3, 4, 4, 5, 7]))): rng.choice([2, 3, 30, 31, 400, 5000]) for _ in range(150)}
    words |= {"a" * k: 10**k for k in range(3, 9)} | {"ab" * 300: 5, "ab" * 300 + "a": 60, "ab" * 150 + "b" + "ab" * 149 + "a": 7}
    found = spelling.spelling_variants(spark.createDataFrame(list(words.items()), "word string, n long"))
    assert variants(found) == variants_by_hand(words)


def test_words_of_texts(spark):
    """Null texts and ids, letters beyond ASCII, repeated rows, one text of a million letters, clashing columns."""
    rng = random.Random(5)
    some = ["different", "Diffërent", "diferent", "Straße", "÷×÷×÷×÷", "ÀÉÎÕÜßÿ", "example", "Example", "exampel", "x" * 40]
    rows = [(rng.choice([None, *range(40)]), " ".join(rng.choice(some) for _ in range(60))) for _ in range(30)]
    rows += rows[:5] + [(7, None), (8, ""), (9, "ab " * 9), (10, "Q" * 1_000_000), (11, "q" * 1_000_000), (12, "q" * 999_999 + "." + "q" * 999_999)]
    frame = spark.createDataFrame([(*r, "w", 1, 1) for r in rows], DOCS)
    words = words_by_hand(rows)
    found = {r.word: r.n for r in spelling.spelled_words(frame).collect()}
    assert found == words
    assert variants(spelling.spelling_variants(spelling.spelled_words(frame))) == variants_by_hand(words)


def test_no_words(spark):
    assert variants(spelling.spelling_variants(spelling.spelled_words(spark.createDataFrame([], DOCS)))) == {}


def test_keys_of_deletions():
    """Equal strings have equal keys, whatever they were cut from; different ones here don't."""
    words = ["", "a", "aa", "abcdefg", "abcdefgh", "xabcdefg", "é" * 50, "bcdefgh"]
    by_key = defaultdict(set)
    for at, place, key in zip(*spelling.deletion_keys(words), strict=True):
        by_key[key].add(words[at] if place < 0 else words[at][:place] + words[at][place + 1 :])
    assert all(len(strings) == 1 for strings in by_key.values())
    assert len(by_key) == len(set().union(*by_key.values()))


def test_collisions_are_verified(spark, monkeypatch):
    """With keys of two bits nearly everything collides, and the strings still decide."""
    real = spelling.deletion_keys
    keys = lambda words: (lambda w, p, k: (w, p, k & spelling._U(3)))(*real(words))
    monkeypatch.setattr(spelling, "deletion_keys", keys)
    words = {"aaab": 2, "aab": 40, "abab": 3, "bbbb": 900, "bbb": 9, "bab": 1}
    import pandas as pd

    batch = pd.DataFrame({"word": list(words), "word_id": range(len(words))})
    rows = pd.concat(spelling._key_rows(iter([batch])))
    same = spelling._colliding(rows)
    same = same.assign(word=[list(words)[i] for i in same["word_id"]])
    same = same.assign(n=[words[w] for w in same["word"]])
    found = {w: (n, near, -less) for w, n, less, near in spelling._near_words(same).groupby("word", as_index=False).agg({"n_near": "sum", "less": "min", "near": "first"}).itertuples(index=False)}
    known = variants_by_hand(words)
    assert {w: x[0] for w, x in found.items()} == {w: x[3] for w, x in known.items() if x[3]}
