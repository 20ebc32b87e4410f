"""Line dedup, prefix trie and divergence audit against plain versions on awkward tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

from reprise.llm import divergence, line_dedup, prefix_trie

BLANK = " \t\n\x0b\x0c\r"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def awkward_lines():
    draw = random.Random(4)
    pool = ["Licence: all", " licence: ALL\t", "É kept", "é kept", "", "   ", "x", "only here é"] + [f"line {i}" for i in range(30)]
    texts = ["\n".join(draw.choice(pool) for _ in range(draw.randint(0, 12))) for _ in range(80)]
    texts += [None, "", "\n", "\n\n", "one\n", "z" * 3_000_000 + "\nlicence: all\n" + "y" * 10, "licence: all\n" * 200]
    rows = [(i, t) for i, t in enumerate(texts)]
    return rows + [rows[3]] * 4 + [(None, texts[5])] * 3 + [(None, None)]


def plain_lines(rows, least, chars=1):
    docs, out = defaultdict(set), []
    for n, (_, text) in enumerate(rows):
        for line in (text or "").split("\n"):
            docs[lower(line.strip(BLANK))].add(n)
    common = {k for k, v in docs.items() if len(v) >= least and len(k) >= chars}
    for i, text in rows:
        lines = (text or "").split("\n")
        left = [x for x in lines if lower(x.strip(BLANK)) not in common]
        out.append((i, len(lines), len(lines) - len(left), sha("\n".join(left))))
    return sorted(out, key=str)


def test_lines_of_many_documents(spark):
    rows = awkward_lines()
    docs = spark.createDataFrame([(i, t, 1, "a") for i, t in rows], "doc_id long, text string, n_lines int, keep string").repartition(7)
    for least, chars in ((10, 1), (3, 2), (1, 5)):
        got = line_dedup.line_digests(docs, least, chars).collect()
        assert sorted(map(tuple, got), key=str) == plain_lines(rows, least, chars)


def test_lines_over_many_ranges(spark):
    """A line that most rows have is spread over ranges; each range's end runs are settled together."""
    rows = [(i, "same\n" + "\n".join(f"{k} {i % 11}" for k in range(4)) + "\nsame") for i in range(300)]
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for least in (10, 28, 301):
            got = line_dedup.line_digests(spark.createDataFrame(rows, "doc_id long, text string"), least).collect()
            assert sorted(map(tuple, got), key=str) == plain_lines(rows, least)
        first = line_dedup.keep_bitmaps(spark.createDataFrame(rows, "doc_id long, text string"), 2, keep_first=True)
        kept = {r["did"]: zlib.decompress(r["keep"])[0] for r in first.collect()}
        assert kept[0] == 0b011111 and all(kept[i] == 0b011110 for i in range(1, 11)) and not any(kept[i] for i in range(11, 300))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])


def test_lines_kept_as_text_and_empty_table(spark):
    docs = spark.createDataFrame([(i, f"Top\nown {i}\nTop ") for i in range(10)], "doc_id long, text string")
    got = line_dedup.without_lines(docs, line_dedup.keep_bitmaps(docs))
    assert sorted(r["text"] for r in got.collect()) == sorted(f"own {i}" for i in range(10))
    assert line_dedup.line_digests(docs.where("false")).collect() == []


def rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((turn is not None, turn or 0), hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest(), (role, text)))
    turns = {c: [t for *_, t in sorted(x, key=lambda y: y[:2])] for c, x in own.items()}
    out = {}
    for c, mine in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = turns.get(c - c % 20, [])[:h] + mine[h:]
    return out


def plain_trie(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = Counter(k[:-1] for k in members if k)
    words = lambda k: len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
    leaves, saved = Counter(), Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not kids[k]
            saved[k[:d]] += (len(m) - 1) * words(k)
    return sorted(
        (min(m), len(k), min(members[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k], sha(",".join(map(str, sorted(c for c in m if len(convs[c]) == len(k))))))
        for k, m in members.items()
    )


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def in_order(df):
    return sorted(tuple(r) for r in df.select(*COLUMNS).collect())


def test_trie_of_awkward_conversations(spark):
    draw = random.Random(7)
    rows = [(c, t, draw.choice(["user", "assistant", None]), draw.choice(["a b", "a\tb c", "", None, "É é"])) for c in range(1200) for t in range(draw.choice([0, 1, 1, 2, 5]))]
    rows += [(c, draw.choice([None, 1, 1]), "user", draw.choice(["x", "y y"])) for c in range(40) for _ in range(3)]
    rows += [rows[0]] * 3 + [(None, 0, "user", "a")] * 5
    table = spark.createDataFrame([(*r, 1, "p") for r in rows], "conv_id long, turn long, role string, text string, depth int, parent_conv_id string")
    assert in_order(prefix_trie.conversation_trie(table)) == plain_trie(rebuilt(rows))
    assert prefix_trie.conversation_trie(table.where("false")).collect() == []
    alone = [(40, 0, "user", "only one")]
    assert in_order(prefix_trie.conversation_trie(spark.createDataFrame(alone, "conv_id long, turn long, role string, text string"))) == plain_trie(rebuilt(alone))


def test_trie_that_is_shared_deeply(spark):
    """Several rounds of blocks, members that end on the way, and many that end in one node."""
    convs = {c: [("u", f"t {d}") for d in range(n)] for c, n in enumerate([300, 300, 299, 150, 8, 4, 0, 300])}
    convs |= {c: convs[0][:140] + [("u", str(c % 3))] for c in range(20, 30)} | {c: [("u", "copy")] for c in range(100, 1400)}
    turns = spark.createDataFrame([(c, d + 1, prefix_symbol(x), len(x[1].split())) for c, ts in convs.items() for d, x in enumerate(ts)], "conv_id long, d int, symbol string, words long")
    lengths = spark.createDataFrame([(c, len(ts)) for c, ts in convs.items()], "conv_id long, length int")
    assert in_order(prefix_trie.trie(turns, lengths)) == plain_trie(convs)


def prefix_symbol(turn):
    return hashlib.md5(":".join(turn).encode()).hexdigest()


def plain_audit(rows, least=10, top=10):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    docs, counts, groups = defaultdict(set), defaultdict(Counter), set()
    for n, (text, lang, source) in enumerate(rows):
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        for t in map(lower, term.findall(text or "")):
            docs[lang, t].add(n)
            counts[lang, source][t] += 1
            counts[lang][t] += 1
    kept = defaultdict(list)
    for (lang, t), d in docs.items():
        if len(d) >= least:
            kept[lang].append(t)

    def shares(key, lang):
        total = sum(counts[key][t] for t in kept[lang])
        return {t: 1 + 10**9 * (counts[key][t] + 2) // (total + 2 * len(kept[lang])) for t in kept[lang]}

    p = {g: shares(g, g[0]) for g in groups} | {lang: shares(lang, lang) for lang, _ in groups}
    gap = lambda x, y: (x - y) ** 2 // (x + y)
    out = []
    for g in groups:
        parts = {"pair": [(o[1], sum(gap(p[g][t], p[o][t]) for t in kept[g[0]])) for o in groups if o[0] == g[0] and o != g]}
        parts["term"] = [(t, gap(p[g][t], p[g[0]][t])) for t in kept[g[0]] if counts[g][t] and p[g][t] > p[g[0]][t]]
        for part, items in parts.items():
            items.sort(key=lambda x: (-x[1], x[0].encode()))
            out += [(*g, part, item, value, n + 1) for n, (item, value) in enumerate(items[: top if part == "term" else None])]
    return sorted(out)


def test_audit_of_awkward_documents(spark, monkeypatch):
    draw = random.Random(9)
    words = ["Word", "word", "É", "é", "l'été", "x1y", "a_b", "naïve", "ZZ", "日本", "\x00q"] + [f"w{chr(97 + i)}" for i in range(26)]
    rows = [(" ".join(draw.choices(words, k=draw.randint(0, 30))), draw.choice(["en", "fr", None]), draw.choice(["s1", "s2", "s3", "s10", None, "big", "big"])) for _ in range(400)]
    rows += [(None, "en", "empty"), ("123 456", "en", "empty"), ("", "de", "s1"), ("rare only", "de", "s2"), ("solo", "xx", "s1"), ("long " * 400_000 + "tail", "en", "s1")] + [rows[0]] * 5
    rows += [("ab" * 1_200_000 + " ab", "en", "s2")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "text string, lang string, source string, term int, many int").repartition(6)
    assert sorted(map(tuple, divergence.audit(docs).collect())) == plain_audit(rows)
    assert divergence.audit(docs.where("false")).collect() == []


def test_audit_in_small_pieces(spark):
    """Runs merged within a task, sent in several lots, and joined over batches."""
    few = [("b a b É", "en", "s1")] * 4 + [("a c", "en", "s2")] * 9 + [("c", "en", "s1")] * 3
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        got = divergence.audit(spark.createDataFrame(few, "text string, lang string, source string"), least_docs=4).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted(map(tuple, got)) == plain_audit(few, 4)
