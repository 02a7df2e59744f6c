"""Plain versions of the operators' contracts, one document at a time and all pairs where pairs matter."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def ascii_lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def simhash(rows, distance=4):
    prints = []
    for _, text in rows:
        words = WORD.findall(ascii_lower(text or ""))
        shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        votes = [0] * 64
        for s in shingles:
            h = xxhash.xxh64(s.encode(), seed=42).intdigest()
            for b in range(64):
                votes[b] += h >> b & 1
        prints.append(sum(1 << b for b in range(64) if votes[b] * 2 > len(shingles)) if shingles else 0)
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= distance:
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, f"{prints[i]:016x}", least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def quality(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    hit = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), len(words) < 10 or 100 * len(hit) > 20 * len(words)


def line_dedup(rows):
    key = lambda line: ascii_lower(line.strip(" \t\n\v\f\r"))
    holders = defaultdict(set)
    for d, text in rows:
        for line in (text or "").split("\n"):
            if d is not None and len(key(line)) >= 10:
                holders[key(line)].add(d)
    out = []
    for d, text in rows:
        lines = (text or "").split("\n")
        keep = [x for x in lines if d is None or len(key(x)) < 10 or len(holders[key(x)]) < 2 or min(holders[key(x)]) == d]
        out.append((d, len(lines), len(lines) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest()))
    return sorted(out, key=str)


def edit_distance_within(item, text):
    """Least edit distance of item to a substring of text (Sellers)."""
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in text:
        prev, row[0] = row[0], 0
        for i in range(1, len(item) + 1):
            prev, row[i] = row[i], min(row[i] + 1, row[i - 1] + 1, prev + (item[i - 1] != c))
        best = min(best, row[-1])
    return best


def token_ids(texts, end):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [e.ids + [end] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def good(rows):
    """Which of (text, host) the base rules and the hosts' allowances keep."""
    measured, hosts = [], defaultdict(list)
    for text, host in rows:
        words, chars, symbols, dup, _, base = quality(text)
        lines = sum(bool(WORD.search(x)) for x in (text or "").split("\n"))
        degrees = (10 * symbols / words if words else 10 * symbols and math.inf, 10 * dup / (3 * lines) if lines else 0, max(chars / (10 * words), 3 * words / chars) if words else 0)
        measured.append((host, base, degrees))
        hosts[host].append(degrees)
    n, k, allowed = len(rows), len(hosts), {}
    spare = n - sum(len(v) ** 2 for v in hosts.values()) / n - (k - 1)
    for r in range(3):
        failed = {h: sum(d[r] > 1 for d in v) for h, v in hosts.items()}
        p = sum(failed.values()) / n
        s = sum(len(v) * (failed[h] / len(v) - p) ** 2 for h, v in hosts.items())
        rho = (s / (p * (1 - p)) - (k - 1)) / spare if 0 < p < 1 and spare else 0
        strength = min(1e6, max(10, (1 - rho) / rho)) if rho > 0 else 1e6
        for h, v in hosts.items():
            allowed[h, r] = 2 - (failed[h] + strength * p) / (len(v) + strength)
    return [not base and all(d <= allowed[host, r] for r, d in enumerate(degrees)) for host, base, degrees in measured]
