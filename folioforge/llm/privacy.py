"""Personal data: patterns, and a linear-chain conditional random field over word shapes.

The patterns find e-mail addresses, IP numbers, payment cards (Luhn) and phone numbers. The field is trained from a small
labelled table (a parameter; the default is made by a rule below) over shapes, cases, affixes and lengths of words and their
neighbours. It tags by Viterbi and adds spans the patterns miss, such as "name (at) host (dot) com", "(555) 010-2233", and
secrets beside the word that announces them. Added spans never overlap base ones.

Whole texts are tagged. The field sees SIDE words on either side of each, and only `none` is open to a word that has no
cue (a digit, an @, at, dot, a word of KEYS) among them or in itself, in training as well. So a word further than SIDE
from every cue is untagged on any path, and the neighbourhoods of cues, with as many words more for what the field sees,
are chains by themselves: tagging them is tagging the whole text.

Null texts are empty; empty texts have no spans. Repeated rows are scanned each. Extra columns are ignored. An empty
table gives no rows. Of equal paths, Viterbi takes the smaller label.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import portions, tidy

KINDS = ("email", "ip", "card", "phone")
#: What the field alone finds comes after the patterns' kinds.
ADDED = ("secret",)
LABELS = ("none", *KINDS, *ADDED)
#: Words on either side whose shapes the field sees.
SIDE = 3
OUT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_spans string, spans string, n_spans long"

# ---- base patterns

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")


def emails(text: str) -> list[tuple[int, int]]:
    """From each @, the run of local characters before it that no match has used, and the domain after it."""
    out, used, at = [], 0, text.find("@")
    while at >= 0:
        before = text[used:at]
        start = used + len(before.rstrip(_LOCAL))
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
            used = m.end()
        else:
            used = at + 1
        at = text.find("@", used)
    return out


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) << (k & 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Leftmost non-overlapping matches of each kind; matches that fail its test are dropped."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        out["email"] = emails(text)
    if not _DIGIT.search(text):
        return out
    if text.count(".") > 2:
        out["ip"] = [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p[-4:] or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() > 15:
            digits = re.sub("[ -]", "", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                out["card"].append(m.span())
    if "+" in text:
        out["phone"] = [m.span() for m in _PHONE.finditer(text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


# ---- the field

_WORD = re.compile(r"\S+")
#: Words that announce a secret.
KEYS = ("token", "secret", "password", "passwd", "pwd", "passphrase", "apikey", "api_key", "api-key", "access_key", "secret_key", "auth_token", "credential")
_CUE = re.compile(r"[0-9@]|(?i:\bdot\b|\bat\b|(?<![a-z])(?:" + "|".join(KEYS) + r")(?![a-z]))")
_AT = {"at", "(at)", "[at]", "{at}", "<at>"}
_DOT = {"dot", "(dot)", "[dot]", "{dot}", "<dot>"}
_QUOTES = "\"'`([{<"
_CORE = re.compile(r"[A-Za-z0-9_+/=.~-]{8,}")


def shape(word: str) -> str:
    """Letters as one a, digits as up to four 9s, the rest as it is; words without a digit by their case, long mixed ones by their kind."""
    word = word.rstrip(",;:!?\"'").lstrip("\"'").removesuffix(".")
    low = word.lower()
    if low in _AT:
        return "AT"
    if low in _DOT:
        return "DOT"
    if low.strip("=:_") in KEYS:
        return "KEY"
    if "@" in word:
        return "x@x.x" if re.search(r"\w@[\w-]+\.\w", word) else "@"
    if not _DIGIT.search(word):
        if not any(c.isalpha() for c in word):
            return "=" if word in ("=", ":", "", "=>", ":=", "->") else "mark"
        if any(k in low for k in KEYS) and ("=" in word or ":" in word):
            return "KEY=w"
        return "w" if word == low else "W" if word[1:] == low[1:] else "U" if word == word.upper() else "wW"
    if re.fullmatch(r"[0-9]{1,3}(\.[0-9]{1,3}){3}([:/][0-9]+)?", word):
        return "9.9.9.9"
    if any(k in low for k in KEYS) and ("=" in word or ":" in word):
        return "KEY=9"
    core = max(_CORE.findall(word), key=len, default="")
    if len(core) >= 16 and re.search("[A-Za-z]", core):
        return "hex" if re.fullmatch("[0-9a-f]+|[0-9A-F]+", core) else "uuid" if re.fullmatch("[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", core) else "mixed"
    out = re.sub(r"[0-9]+", lambda m: "9" * min(4, len(m[0])) + "+" * (len(m[0]) > 4), re.sub(r"[^\W0-9_]+", "a", word))
    return out if len(out) <= 24 else "long"


def affixes(word: str) -> str:
    """How a word begins and ends, and about how long it is."""
    if word.lower().strip(",;:!?\"'.") in _AT | _DOT:
        return "AT"
    first = "q" if word[0] in _QUOTES else "+" if word[0] == "+" else "9" if word[0].isdigit() else "A" if word[0].isupper() else "a"
    last = "." if word[-1] in ".!?" else "," if word[-1] in ",;" else ":" if word[-1] in ":=" else "q" if word[-1] in "\"'`)]}>" else "9" if word[-1].isdigit() else "a"
    n = len(word)
    return first + last + ("1" if n < 3 else "3" if n < 6 else "6" if n < 12 else "b" if n < 24 else "c" if n < 36 else "d")


#: Shapes of words that are no cue: what stands far from any cue is made of them.
PLAIN = ("w", "W", "U", "wW", "mark", "=")


def training_table(seed: int = 5, rows: int = 600) -> list[list[tuple[str, str]]]:
    """A small labelled table: sentences of (word, label), from patterns of values in plain and numeric contexts."""
    rng = np.random.default_rng(seed)
    n = lambda k: "".join(str(x) for x in rng.integers(0, 10, k))
    hexa = lambda k: "".join("0123456789abcdef"[x] for x in rng.integers(0, 16, k))
    mixed = lambda k: "".join("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz0123456789"[x] for x in rng.integers(0, 59, k)) + n(1)
    pick = lambda x: x[rng.integers(len(x))]

    def w() -> str:
        k = rng.integers(0, 40)
        x = "".join(chr(97 + x) for x in rng.integers(0, 26, rng.integers(12, 40) if k % 5 == 0 else rng.integers(1, 12)))
        if k >= 30:
            return pick(['"', "(", "[", "'", "*", ""]) + x + pick(['"', ")", "]", "'", "?", ";"])
        return x.capitalize() if k < 4 else x.upper() if k == 4 else x + pick([".", ",", ":", "!", "###", "***", "%%%"]) if k < 8 else pick(["=", "-", "|"]) if k == 8 else x

    some = lambda a, b: [(w(), "none") for _ in range(rng.integers(a, b))]
    ip = lambda: ".".join(str(x) for x in rng.integers(0, 256, 4))
    key = lambda: pick(KEYS)
    values = {
        "email": [lambda: f"{w()}.{n(2)}@{w()}.com", lambda: f"{w()}@{w()}{n(1)}.example.org", *[lambda a=a, d=d: f"{w()} {a} {w()} {d} com" for a, d in (("(at)", "(dot)"), ("[at]", "[dot]"), ("at", "dot"))], lambda: f"{w()} (at) {w()} (dot) {w()} (dot) org"],
        "ip": [ip, ip, lambda: f"{ip()}:{n(4)}", lambda: f"{ip()}/{n(2)}"],
        "card": [lambda: f"{n(4)} {n(4)} {n(4)} {n(4)}", lambda: f"{n(4)}-{n(4)}-{n(4)}-{n(4)}"],
        "phone": [lambda: f"+{n(1)} ({n(3)}) {n(3)}-{n(4)}", lambda: f"({n(3)}) {n(3)}-{n(4)}", lambda: f"{n(3)}-{n(3)}-{n(4)}", lambda: f"+{n(2)} {n(3)} {n(3)} {n(4)}", lambda: f"{n(3)}.{n(3)}.{n(4)}"],
        "secret": [lambda: f'{key()} = "{hexa(rng.integers(24, 65))}"', lambda: f"{key()}: {mixed(rng.integers(16, 48))}", lambda: f"{key()} = '{mixed(rng.integers(16, 40))}'", lambda: f"{key()} is {hexa(32)}", lambda: f"{key()}={mixed(24)}", lambda: f'{key()} "{mixed(20)}"'],
    }
    plain = [lambda: f"version {n(1)}", lambda: f"version {n(1)}.{n(1)}", lambda: f"{w()} 4.0", lambda: n(4), lambda: f"20{n(2)}-0{n(1)}-1{n(1)}", lambda: f"{n(2)}:{n(2)}", lambda: n(3), lambda: f"{n(1)},{n(3)}", lambda: f"{n(4)}-{n(4)}", lambda: f"{w()}{n(6)}{w()}", lambda: f"{n(2)} {w()} {n(4)}", lambda: f"${n(2)}.{n(2)}", lambda: f"{n(2)}%", lambda: f"@{w()}", lambda: f"a dot {w()}", lambda: f"at {w()} at", lambda: f"{n(3)} {n(3)}", lambda: f"20{n(2)}-0{n(1)}-1{n(1)} at {n(2)}:{n(2)}", lambda: f"{w()} at {n(2)}:{n(2)}", lambda: f"{w()} at {w()} {w()}", lambda: f"{n(1)}. {w()} {n(1)}. {w()}", lambda: n(8), lambda: n(16), lambda: f"commit {hexa(40)}", lambda: f"sha256 {hexa(64)}", lambda: f"{w()} {hexa(8)}-{hexa(4)}-{hexa(4)}-{hexa(4)}-{hexa(12)}", lambda: f"{w()} {hexa(32)} {w()}", lambda: f"the {key()} {w()} {w()}", lambda: f"{key()} {n(2)}", lambda: f"a {key()} of {w()}", lambda: f"{key()}: {w()} {w()}", lambda: f"file {mixed(20)}"]
    announce = {"secret"}  # the announcing words are no part of the secret
    out = []
    for k in range(rows):
        kind = pick(LABELS[1:]) if k % 2 else "none"
        text = pick(values[kind])() if kind != "none" else pick(plain)()
        words = text.split()
        tags = [kind] * len(words)
        if kind in announce:
            tags = ["none"] * (len(words) - 1) + [kind]
        out.append(some(1, 7) + list(zip(words, tags)) + some(0, 7))
    return out + [some(8, 24) for _ in range(100)]


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


#: The score of a tag that is not open.
SHUT = -1e6


class Field:
    """Weights: for each offset from -SIDE to SIDE, of each shape and each affix for each label; and of each step from label to label.

    A sequence begins and ends beside an untagged word.
    """

    def __init__(self, table: list[list[tuple[str, str]]], steps: int = 120, rate: float = 0.15, decay: float = 2e-3):
        shapes = sorted({shape(x) for row in table for x, _ in row} - {"w"})
        ends = sorted({affixes(x) for row in table for x, _ in row})
        self.number = {"w": 0, "unseen": 1} | {s: k + 2 for k, s in enumerate(shapes)}
        self.end = {"unseen": 0} | {s: k + 1 for k, s in enumerate(ends)}
        self.wide = len(self.end)
        self.emit = np.zeros((2 * SIDE + 1, len(self.number), len(LABELS)))
        self.ends = np.zeros((2 * SIDE + 1, self.wide, len(LABELS)))
        self.step = np.zeros((len(LABELS), len(LABELS)))
        rows = [[self.feature(x) for x, _ in row] for row in table]
        tags = [[LABELS.index(y) for _, y in row] for row in table]
        self._fit(rows, tags, steps, rate, decay)

    def feature(self, word: str) -> int:
        """Shape and affix of a word, and whether it is a cue, in one number."""
        return 2 * (self.number.get(shape(word), 1) * self.wide + self.end.get(affixes(word), 0)) + bool(_CUE.search(word))

    def scores(self, grid: np.ndarray) -> np.ndarray:
        """Rows x places x labels; grid has SIDE columns of padding on either side."""
        n = grid.shape[1] - 2 * SIDE
        cue, grid = grid & 1, grid >> 1
        out = sum(self.emit[k][grid[:, k : k + n] // self.wide] + self.ends[k][grid[:, k : k + n] % self.wide] for k in range(2 * SIDE + 1))
        out[sum(cue[:, k : k + n] for k in range(2 * SIDE + 1)) == 0, 1:] = SHUT
        return out

    @staticmethod
    def grid(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.array([len(r) for r in rows])
        out = np.zeros((len(rows), int(sizes.max()) + 2 * SIDE), dtype=np.int64)
        for k, r in enumerate(rows):
            out[k, SIDE : SIDE + len(r)] = r
        return out, sizes

    def _fit(self, rows, tags, steps, rate, decay) -> None:
        grid, sizes = self.grid(rows)
        gold, _ = self.grid(tags)
        gold = gold[:, SIDE:-SIDE]
        b, n, m = len(rows), gold.shape[1], len(LABELS)
        live = np.arange(n) < sizes[:, None]
        params, means, squares = (self.emit, self.step, self.ends), [0, 0, 0], [0, 0, 0]
        shapes, ends = (grid >> 1) // self.wide, (grid >> 1) % self.wide
        hot = np.eye(m)[gold] * live[..., None]
        for t in range(1, steps + 1):
            s = self.scores(grid)
            fwd = np.zeros((b, n, m))
            bwd = np.zeros((b, n, m))
            fwd[:, 0] = s[:, 0] + self.step[0]
            for k in range(1, n):
                nxt = _log_sum(fwd[:, k - 1, :, None] + self.step, 1) + s[:, k]
                fwd[:, k] = np.where(live[:, k, None], nxt, fwd[:, k - 1])
            bwd[:] = self.step[:, 0]
            for k in range(n - 2, -1, -1):
                nxt = _log_sum(self.step + (s[:, k + 1] + bwd[:, k + 1])[:, None, :], 2)
                bwd[:, k] = np.where(live[:, k + 1, None], nxt, self.step[:, 0])
            z = _log_sum(fwd[:, -1] + self.step[:, 0], 1)
            p = np.exp(fwd + bwd - z[:, None, None]) * live[..., None]
            diff = hot - p
            g_emit, g_ends = np.zeros_like(self.emit), np.zeros_like(self.ends)
            for k in range(2 * SIDE + 1):
                np.add.at(g_emit[k], shapes[:, k : k + n].ravel(), diff.reshape(-1, m))
                np.add.at(g_ends[k], ends[:, k : k + n].ravel(), diff.reshape(-1, m))
            g_step = np.zeros_like(self.step)
            both = live[:, 1:, None, None]
            pair = np.exp(fwd[:, :-1, :, None] + self.step + (s + bwd)[:, 1:, None, :] - z[:, None, None, None]) * both
            g_step += (hot[:, :-1, :, None] * hot[:, 1:, None, :]).sum((0, 1)) - pair.sum((0, 1))
            g_step[0] += diff[:, 0].sum(0)
            at = (np.arange(b), sizes - 1)
            g_step[:, 0] += diff[at].sum(0)
            for i, (w, g) in enumerate(zip(params, (g_emit, g_step, g_ends))):
                g = g / b - decay * w
                means[i] = 0.9 * means[i] + 0.1 * g
                squares[i] = 0.999 * squares[i] + 0.001 * g * g
                w += rate * (means[i] / (1 - 0.9**t)) / (np.sqrt(squares[i] / (1 - 0.999**t)) + 1e-8)

    def viterbi(self, rows: list[list[int]]) -> list[list[int]]:
        """Best labels of many sequences at once, the longest first so that short ones drop out."""
        if not rows:
            return []
        order = sorted(range(len(rows)), key=lambda k: -len(rows[k]))
        out: list[list[int]] = [[]] * len(rows)
        for at in range(0, len(order), 4096):
            part = order[at : at + 4096]
            grid, sizes = self.grid([rows[k] for k in part])
            s = self.scores(grid)
            n = s.shape[1]
            back = np.zeros((len(part), n, len(LABELS)), dtype=np.int8)
            best = s[:, 0] + self.step[0]
            for k in range(1, n):
                m = int((sizes > k).sum())
                paths = best[:m, :, None] + self.step
                back[:m, k] = paths.argmax(1)
                best[:m] = paths.max(1) + s[:m, k]
            last = (best + self.step[:, 0]).argmax(1)
            tags = np.zeros((len(part), n), dtype=np.int8)
            for k in range(n - 1, -1, -1):
                m = int((sizes > k).sum())
                last[:m] = np.where(sizes[:m] - 1 == k, last[:m], back[np.arange(m), min(k + 1, n - 1), last[:m]])
                tags[:m, k] = last[:m]
            for k, i in enumerate(part):
                out[i] = tags[k, : sizes[k]].tolist()
        return out


@functools.lru_cache(maxsize=1)
def field() -> Field:
    return Field(training_table())


def segments(text: str, reach: int) -> list[list[tuple[int, int]]]:
    """Runs of words (their spans) within reach of a word that holds a cue."""
    out: list[list[tuple[int, int]]] = []
    end = -1
    pos = 0
    while m := _CUE.search(text, max(pos, 0)):
        start = m.start()
        # reach words back
        left = start
        while left > 0 and not text[left - 1].isspace():
            left -= 1
        cue_left = left
        for _ in range(reach):
            k = left
            while k > 0 and text[k - 1].isspace():
                k -= 1
            while k > 0 and not text[k - 1].isspace():
                k -= 1
            left = k
        words = []
        for k, x in enumerate(_WORD.finditer(text, cue_left)):
            words.append(x.span())
            if k == reach:
                break
        if left < end and out:
            known = out[-1][-1][1]
            out[-1] += [x for x in ([y.span() for y in _WORD.finditer(text, known, cue_left)] + words) if x[0] >= known]
        else:
            out.append([y.span() for y in _WORD.finditer(text, left, cue_left)] + words)
        end = out[-1][-1][1]
        pos = words[0][1]  # on behind this word
    return out


def plausible(kind: str, text: str) -> bool:
    """The least that a tagged span must hold to be of its kind."""
    digits = sum(c.isascii() and c.isdigit() for c in text)
    if kind == "email":
        shapes = [shape(x) for x in text.split()]
        return "x@x.x" in shapes or ("AT" in shapes[1:-1] and "DOT" in shapes[shapes.index("AT") + 2 : -1])
    if kind == "ip":
        return len(re.findall("[0-9]+", text)) in (4, 5) and text.count(".") == 3
    if kind == "secret":
        return len(text) >= 12 and digits > 0 and any(c.isalpha() for c in text)
    return 13 <= digits <= 19 if kind == "card" else 7 <= digits <= 15


def trimmed(kind: str, text: str, a: int, b: int) -> tuple[int, int]:
    """The span without marks at its end; of a secret the longest run of its characters in the tagged words."""
    if kind == "secret":
        runs = [(a + m.start(), a + m.end()) for m in _CORE.finditer(text[a:b])]
        a, b = max(runs, key=lambda x: x[1] - x[0], default=(a, a))
        if "=" in text[a:b].rstrip("="):  # name=value in one word
            a += text[a:b].rstrip("=").index("=") + 1
        return a, b
    while b > a and text[b - 1] in ".,;:!?\"'":
        b -= 1
    return a, b


Spans = dict[str, list[tuple[int, int]]]


def scan(texts: list[str], crf: Field | None = None) -> list[tuple[Spans, Spans]]:
    """Base spans and all spans of each text."""
    crf = crf or field()
    found, rows, owners = [], [], []
    for i, text in enumerate(texts):
        found.append(base_spans(text))
        if _CUE.search(text):
            for seg in segments(text, 2 * SIDE):
                rows.append([crf.feature(text[a:b]) for a, b in seg])
                owners.append((i, seg))
    out = [(base, {k: list(base.get(k, ())) for k in (*KINDS, *ADDED)}) for base in found]
    for (i, seg), tags in zip(owners, crf.viterbi(rows)):
        if not any(tags):
            continue
        k = 0
        while k < len(tags):
            j = k
            while j + 1 < len(tags) and tags[j + 1] == tags[k]:
                j += 1
            if tags[k]:
                kind = LABELS[tags[k]]
                a, b = trimmed(kind, texts[i], seg[k][0], seg[j][1])
                taken = [x for v in out[i][0].values() for x in v]
                if b > a and plausible(kind, texts[i][a:b]) and all(b <= x or y <= a for x, y in taken):
                    out[i][1][kind].append((a, b))
            k = j + 1
    return out


def joined(spans: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in (*KINDS, *ADDED) for a, b in sorted(spans.get(k, ())))


def find(docs: DataFrame, table: list[list[tuple[str, str]]] | None = None) -> DataFrame:
    """doc_id, counts of base spans by kind, base_spans and spans as kind:start:end (code points, end exclusive), n_spans.

    table: sentences of (word, label) to train from; the default is training_table().
    """
    crf = Field(table) if table else field()  # its few weights go along with the function

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, 1):
            got = scan([t or "" for t in batch.column(1).to_pylist()], crf)
            cols = [batch.column(0)]
            cols += [pa.array([len(base[k]) for base, _ in got], pa.int64()) for k in KINDS]
            cols += [pa.array([joined(x[i]) for x in got], pa.string()) for i in (0, 1)]
            cols.append(pa.array([sum(map(len, every.values())) for _, every in got], pa.int64()))
            yield pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in OUT.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run), OUT)
