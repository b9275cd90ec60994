"""Plain versions of the contracts, one row at a time."""

import base64
import hashlib
import re
import zlib
from itertools import combinations

import public_tokenizers
import xxhash


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def op1(pages):
    """{page_id: (payload_bytes, payload_digest, record_type, refers_to)}"""
    out, first = {}, {}
    for page, html in sorted(pages):
        data = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        head = first.setdefault(digest, page)
        out[page] = (len(data), digest, "response" if head == page else "revisit", None if head == page else head)
    return out


def op3(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out, start = {}, 0
    for doc, text in sorted(docs):
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        out[doc] = (start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids)))
        start += len(ids)
    return out


def tiktoken_encoding():
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def op4(docs):
    e = tiktoken_encoding()
    out = {}
    for doc, text in docs:
        ids = e.encode_ordinary(text or "")
        out[doc] = (len(ids), sha(",".join(map(str, ids))), sha((text or "").encode()))
    return out


def words7(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def op7(docs, items):
    windows = {}
    for item, text in items:
        w = words7(text)
        n = min(10, len(w))
        for j in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[j : j + n]), set()).add(str(item))
    sizes = {len(w) for w in windows}
    out = {}
    for doc, text in docs:
        w, hit, found = words7(text), set(), set()
        for i in range(len(w)):
            for n in sizes:
                if i + n <= len(w) and (who := windows.get(tuple(w[i : i + n]))):
                    hit |= set(range(i, i + n))
                    found |= who
        out[doc] = (len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit))
    return out


def op8(docs):
    kinds = (
        ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 8),
        ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
        ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 32),
    )
    out = {}
    for doc, text in docs:
        spans = sorted((m.start(), k, m.end(), name) for k, (name, rx, ok) in enumerate(kinds) for m in rx.finditer(text or "") if ok(m))
        n = [sum(s[1] == k for s in spans) for k in range(3)]
        out[doc] = (*n, sha(",".join(f"{s[3]}:{s[0]}:{s[2]}" for s in spans)))
    return out


def fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def op9(docs):
    prints = {d: fingerprint(t) for d, t in docs}
    parent = {f: f for f in prints.values()}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(list(parent), 2):
        if (a ^ b).bit_count() <= 2:
            parent[root(a)] = root(b)
    least = {}
    for d, f in prints.items():
        least[root(f)] = min(least.get(root(f), d), d)
    return {d: (f"{f:016x}", least[root(f)]) for d, f in prints.items()}


def fuzzy(text):
    """Chunk by chunk, byte by byte; constants as in the module's description."""
    data, mix, base, full = (text or "").encode(), 0xD6E8FEB86659FD93, 0x9E3779B97F4A7C15, (1 << 64) - 1
    if not data:
        return "3::"
    weight = [pow(31, 3 * back + 1, 1 << 32) for back in range(7)]
    rolled = [(sum(data[i - back] * weight[back] for back in range(min(7, i + 1))) * mix & full) >> 32 for i in range(len(data))]

    def chunks(block):
        out, chunk = [], b""
        for x, r in zip(data, rolled):
            chunk += bytes([x])
            if r % block == block - 1:
                out.append(chunk)
                chunk = b""
        return out + [chunk] * bool(chunk)

    def letters(block):
        out = ""
        for c in chunks(block):
            h, power = 0, 1
            for x in c:
                h, power = h + (x + 1) * power & full, power * base & full
            h = (h ^ h >> 29) * mix & full
            out += "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"[h >> 58]
        return out

    block = 3
    while len(chunks(block)) > 64:
        block *= 2
    return f"{block}:{letters(block)}:{letters(2 * block)}"


def edit_share(a, b):
    """1 - insertions and deletions by total length."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(row[j] if x == y else 1 + min(row[j + 1], new[j]))
        row = new
    return 1 - row[-1] / (len(a) + len(b)) if a or b else 1.0


def fuzzy_likeness(a, b):
    (x, x1, x2), (y, y1, y2) = a.split(":"), b.split(":")
    x, y = int(x), int(y)
    out = 1.0 if a == b else 0.0
    if x == y:
        out = max(out, edit_share(x1, y1), edit_share(x2, y2))
    if x == 2 * y:
        out = max(out, edit_share(x1, y2))
    if y == 2 * x:
        out = max(out, edit_share(x2, y1))
    return out


def op6(docs):
    """{doc_id: (n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)}"""
    docs = sorted(docs, reverse=True)
    known, out = {}, {}

    def fp(t):
        if t not in known:
            known[t] = fuzzy(t)
        return known[t]

    for i, (doc, text) in enumerate(docs):
        text, then = text or "", docs[(i + 1) % len(docs)][1] or ""
        n = len(text) // 3
        new = text[: len(text) - n] + then[:n]
        out[doc] = (len(text), sha(new), fp(text), fp(new), fuzzy_likeness(fp(text), fp(new)), fuzzy_likeness(fp(text), fp(then)))
    return out


def quality_features(text, n_chars=None):
    """{bucket: value} of the words, and the list of statistics and metadata, one thing at a time."""
    import math
    from collections import Counter

    words, total = Counter(text.split()), max(1, len(text.split()))
    by_bucket = Counter()
    for w, c in words.items():
        by_bucket[zlib.crc32(w.lower().encode()) % 8192] += c
    norm = math.sqrt(sum(math.log(1 + c) ** 2 for c in by_bucket.values())) or 1
    n, lines, ascii_marks = max(1, len(text)), text.split("\n"), set("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
    share = lambda ok: sum(map(ok, text)) / n
    stats = [
        share(lambda c: "A" <= c <= "Z"), share(lambda c: "0" <= c <= "9"), share(lambda c: c in ascii_marks), share(lambda c: c == " "),
        share(lambda c: ord(c) >= 128), math.log(1 + n / total) / 3, len(words) / total, max(words.values(), default=0) / total,
        len(set(lines)) / len(lines), math.log(1 + n / len(lines)) / 8, text.count("|") / total,
        len(re.findall(r"([!?*#$%&|+=~^<>_-])\1", text)) / total, sum(text.count(c) for c in "!.?") / total, math.log(1 + n) / 10, 1 / (1 + total)]
    meta = len(text) if n_chars is None else n_chars
    return {b: math.log(1 + c) / norm for b, c in by_bucket.items()}, [*stats, math.log(1 + meta) / 10, math.log((1 + meta) / (1 + len(text)))]


def machine_raw(m, pairs):
    """Score of [(place, value)] with every pair written out."""
    out = m.bias + sum(m.linear[i] * x for i, x in pairs)
    for k, (i, x) in enumerate(pairs):
        for j, y in pairs[:k]:
            out += float(m.factors[i] @ m.factors[j]) * x * y
    return out


def toxic_ngrams(text):
    t = f" {(text or '').lower()} "
    return {t[i : i + n] for n in (3, 4, 5, 6) for i in range(len(t) - n + 1)}


def near_copies(docs, words=5, likeness=0.8):
    """{doc_id: smallest id of its group}: every pair of distinct texts compared by their shingle sets."""
    sets = {}
    for doc, text in docs:
        w = (text or "").encode().lower().split()
        sets[doc] = {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sets, 2):
        if min(len(sets[a]), len(sets[b])) >= likeness * max(len(sets[a]), len(sets[b])) - 1e-9:
            both = len(sets[a] & sets[b])
            if both / (len(sets[a]) + len(sets[b]) - both) >= likeness - 1e-12:
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {d: root(d) for d in sets}


def host_path(url):
    """(host, path) of a URL."""
    _, there, rest = (url or "").partition("://")
    host = re.match(r"[^/?#]*", rest).group() if there else ""
    path = re.match(r"[^?#]*", rest[len(host):]).group() if there else ""
    return "".join(c.lower() if c.isascii() else c for c in host), path


def op11(url, rules, listed):
    """(host, path, rule, verdict)"""
    host, path = host_path(url)
    fits = [(len(h) + len(p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    _, _, rule, verdict = max(fits, default=(0, 0, None, "block" if host + path in listed else "allow"))
    return host, path, rule, verdict


def _folded(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "")


def op12(docs, items, k):
    """Sorted (item, rank, doc_id, score); items that share an id are one."""
    import math
    from collections import Counter

    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    bags = [(d, Counter(term.findall(_folded(t)))) for d, t in docs]
    bags = [(d, b, sum(b.values())) for d, b in bags if b]
    all_n, all_l = len(bags), sum(n for *_, n in bags)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(term.findall(_folded(t)))
    out = []
    for i, terms in wanted.items():
        found = []
        weight = {t: df and math.floor(1000 * math.log((2 * all_n + 2) / (2 * df + 1))) for t in terms for df in [sum(t in b for _, b, _ in bags)]}
        for d, b, n in bags:
            m = 100 - 50 + 50 * n * all_n // all_l
            score = sum(w * (1000000000 * b[t] // (1000 * b[t] + 20 * m)) for t, w in weight.items())
            if score > 0:
                found.append((-score, d is None, d or 0))
        out += [(i, r, None if null else d, -s) for r, (s, null, d) in enumerate(sorted(found)[:k], 1)]
    return out if any(i is None for i in wanted) else sorted(out)


def one_edit(a, b):
    """Whether one inserted, deleted or replaced symbol makes ``b`` of ``a``."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def variants(words):
    """Sorted (word, form, root, n, n_near, form_n) of {word: n}."""
    form, n_near = {}, {}
    for w, n in words.items():
        near = [v for v in words if one_edit(w, v)]
        best = min(near, key=lambda v: (-words[v], v), default=None)
        n_near[w], form[w] = len(near), best if best is not None and words[best] >= 5 * n else None
    def root(w):
        return w if form[w] is None else root(form[w])
    return sorted((w, form[w], root(w), n, n_near[w], words.get(form[w])) for w, n in words.items())


def op13(docs):
    from collections import Counter

    counts = Counter()
    for d, t in docs:
        for run in re.findall("[a-z\u00c0-\u00ff]+", _folded(t)):
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return variants({w: n for w, n in counts.items() if len(w) >= 6 and n >= 5})
