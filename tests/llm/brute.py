"""Plain versions of the contracts, one row after another."""

from __future__ import annotations

import base64
import hashlib
import html
import math
import re
import uuid
from collections import defaultdict

import numpy as np
import xxhash

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def words(text: str | None) -> list[str]:
    return WORD.findall(lower(text))


def decontamination(docs, items, size=10):
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            windows[tuple(w[i : i + size])].add(str(item))
    lengths = {len(w) for w in windows}
    out = {}
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if (x := tuple(w[i : i + n])) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[x]
        out[doc] = (len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit))
    return out


def chat(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        convs[conv].append((turn, role or "", text or ""))
    convs[-1] = [(0, "user", "<|im_end|><|im_start|>assistant ok"), (1, "assistant", "<|im_end|><|im_start|>assistant ok")]
    out = {}
    for conv, turns in convs.items():
        turns.sort()
        learned = "".join(t for _, r, t in turns if r == "assistant")
        out[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(learned), sha(learned))
    return out


BASE = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def luhn(digits: str) -> bool:
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def base_spans(text: str | None) -> list[tuple[int, int, str]]:
    out = []
    for rank, (kind, pattern) in enumerate(BASE):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": lambda m=m: True, "ip": lambda m=m: all(int(x) <= 255 for x in m[0].split(".")), "card": lambda d=digits: 14 <= len(d) <= 19 and luhn(d), "phone": lambda d=digits: 10 <= len(d) <= 15}[kind]()
            if ok:
                out.append((m.start(), rank, kind, m.end()))
    return [(s, e, k) for s, _, k, e in sorted(out)]


def pii(docs):
    out = {}
    for doc, text in docs:
        spans = base_spans(text)
        out[doc] = (*(sum(k == kind for _, _, k in spans) for kind, _ in BASE), sha(",".join(f"{k}:{s}:{e}" for s, e, k in spans)))
    return out


def simhash(docs, n=4, distance=4):
    prints = {}
    for doc, text in docs:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", lower(text)) if x]
        shingles = [" ".join(w[k : k + n]) for k in range(max(1, len(w) - n + 1))] if w else []
        counts = [0] * 64
        for s in shingles:
            h = xxhash.xxh64_intdigest(s.encode(), 42)
            for b in range(64):
                counts[b] += h >> b & 1
        prints[doc] = sum(1 << b for b in range(64) if counts[b] * 2 > len(shingles))
    ids = sorted(prints)
    a, parent = np.array([prints[i] for i in ids], np.uint64), {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for k, i in enumerate(ids):
        for j in (np.flatnonzero(np.bitwise_count(a[k + 1 :] ^ a[k]) <= distance) + k + 1).tolist():
            p, q = find(i), find(ids[j])
            parent[max(p, q)] = min(p, q)
    return {i: (f"{prints[i]:016x}", find(i)) for i in ids}


PHRASES = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}


def licenses(docs):
    out = {}
    for doc, text in docs:
        w = words(text)
        starts = {k: [i for i in range(len(w)) if w[i : i + len(p.split())] == p.split()] for k, p in PHRASES.items()}
        every = sorted(x for s in starts.values() for x in s)
        out[doc] = (len(w), len(every), every[0] if every else None, every[-1] if every else None, ",".join(sorted(k for k, s in starts.items() if s)))
    return out


def exact(docs):
    groups = defaultdict(list)
    for doc, text in docs:
        groups[lower(text)].append(doc)
    return {d: (max(g), len(g), d == max(g), sha(t)) for t, g in groups.items() for d in g}


def repeats(docs, size=100):
    """docs by doc_id; bytes covered by a window that also starts earlier go."""
    seen, out = set(), {}
    for doc, text in sorted(docs, key=lambda x: x[0]):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - size + 1):
            w = b[i : i + size]
            if w in seen:
                gone[i : i + size] = b"\1" * size
            else:
                seen.add(w)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[doc] = (len(b), sum(gone), spans, sha(kept))
    return out


# ---- Pages, by patterns over the whole page.

HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|template|noscript|svg|head)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
BLOCK = re.compile(r"</?(?:p|div|br|li|ul|ol|tr|table|h[1-6]|section|article|header|footer|nav|main|aside|blockquote|pre|td|th|hr|form|title|body|html)\b[^>]*>", re.I)


def page_text(page: str) -> str:
    text = html.unescape(re.sub(r"</?[a-zA-Z!?][^>]*>", "", BLOCK.sub("\n", HIDDEN.sub(" ", page))))
    return "\n".join(line for x in text.split("\n") if (line := " ".join(x.split())))


def warc(pages):
    """(page_id, kind) -> record ids, digests, length and the record's hash, for pages of (page_id, url, html)."""

    def named(*names):
        return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(0).join(names))}>"

    def digest(b):
        return "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()

    out = []
    for page, url, body in pages:
        url, body = url or "", body or ""
        own = digest(body.encode())
        source = named("response", str(page), url, own)
        title = re.search(r"<title\b[^>]*>(.*?)</title\s*>", body, re.S | re.I)
        lang = re.search(r"<html\b[^>]*?\blang\s*=\s*[\"']?([\w-]+)", body, re.I)
        links = [html.unescape(a or b or c) for a, b, c in re.findall(r"<a\b[^>]*?\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", body, re.I)]
        text = page_text(body)
        headers = ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body.encode())}"]
        conversion = named("conversion", source)
        lines = [f"title: {page_text(title[1]) if title else ''}", f"language: {lang[1] if lang else ''}", f"conversion: {conversion}", f"characters: {len(text)}", f"links: {len(links)}"]
        lines += [f"source-header: {x}" for x in headers] + [f"outlink: {' '.join(x.split())}" for x in links]
        lines = [" ".join(x.replace("\n", " ").split(" ")) for x in lines]
        for kind, name, mime, block in (("metadata", named("metadata", source), "application/warc-fields", "".join(f"{x}\r\n" for x in lines)), ("conversion", conversion, "text/plain", text)):
            raw = block.encode()
            head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {name}\r\nWARC-Refers-To: {source}\r\nWARC-Target-URI: {' '.join(url.split())}\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Block-Digest: {digest(raw)}\r\nX-Source-Payload-Digest: {own}\r\nContent-Type: {mime}\r\nContent-Length: {len(raw)}\r\n\r\n"
            out.append((page, kind, name, source, own, digest(raw), len(raw), sha(head.encode() + raw + b"\r\n\r\n")))
    return sorted(out, key=repr)


# ---- Sampled pieces and chain scores, step by step.


def sampled(text, key, vocabulary, uniform):
    """Tokens of one text: forward sums over each unit's lattice, then one draw per step from its end."""
    out, place, mask = [], 0, (1 << 64) - 1
    for unit in re.findall(rb"\n| *[^ \n]+| +", text):
        edges = defaultdict(list)
        chars = [i for i in range(len(unit)) if unit[i] & 0xC0 != 0x80] + [len(unit)]
        for length in range(1, vocabulary.longest + 1):
            for i in chars[:-1]:
                if i + length <= len(unit) and (piece := vocabulary.ids.get(unit[i : i + length])) is not None:
                    edges[i + length].append((i, piece))
        for a, b in zip(chars[:-1], chars[1:], strict=True):
            if unit[a:b] not in vocabulary.ids:
                for i in range(a, b):
                    edges[i + 1].append((i, int(vocabulary.bytes[unit[i]])))
        total = {0: 0.0}
        for end in range(1, len(unit) + 1):
            ways = [total[i] + vocabulary.weight[p] for i, p in edges[end] if i in total]
            if ways:
                total[end] = max(ways) + math.log(sum(math.exp(x - max(ways)) for x in ways))
        drawn, at, step = [], len(unit), 0
        while at:
            step += 1
            u = float(uniform(np.array([(key + (place + step) * 0x9E3779B97F4A7C15) & mask], np.uint64))[0])
            for i, p in edges[at]:
                u -= math.exp(total[i] + vocabulary.weight[p] - total[at]) if i in total else 0.0
                if u < 0:
                    break
            drawn.append(p)
            at = i
        out += drawn[::-1]
        place += len(unit)
    return out


def chain_score(chain, text):
    """The score by forward and backward sums over every word, none left out."""
    from decidra.llm.toxicity import around, evidence

    w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text).encode())
    own = [chain.feature(x) for x in w]
    up = [np.array([1.0, math.exp(chain.bias + (chain.weights[f] + sum(chain.context.get(c, 0.0) for c in around(w, i)) if f else 0.0))]) for i, f in enumerate(own)]
    ahead, behind, moves = [], [np.ones(2)], np.exp(chain.moves)
    for x in up:
        m = x if not ahead else (ahead[-1] @ moves) * x
        ahead.append(m / m.sum())
    for x in reversed(up[1:]):
        m = moves @ (x * behind[-1])
        behind.append(m / m.sum())
    both = [a * b for a, b in zip(ahead, reversed(behind), strict=True)] if w else []
    return chain.score([x[1] / x.sum() for x, f in zip(both, own, strict=True) if f])


def license_labels(text, templates, mandatory, share, shift):
    """Label -> best share over every place at which a template could begin, with a mandatory phrase inside."""
    w, best = words(text), {}
    for label, texts in templates.items():
        starts = [i for p in mandatory[label] for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        for t in (x.split() for x in texts):
            band = len(t) // shift
            for at in range(-len(t), len(w)) if starts else ():
                if any(at - band <= s < at + len(t) + band for s in starts):
                    hit = sum(any(0 <= at + j + d < len(w) and w[at + j + d] == x for d in range(-band, band + 1)) for j, x in enumerate(t)) / len(t)
                    if hit >= share and hit > best.get(label, 0):
                        best[label] = hit
    return best
