"""Secret scan by a linear-chain conditional random field.

Patterns give the base spans.  Beside them a CRF tags tokens as begin, inside or outside of a secret, from their shape,
their neighbours' words and features of the whole text, and Viterbi gives the best tags.  Tokens are told apart before
that: what can belong to a secret are tokens with digits or of mixed case and some length, and the NEAR tokens behind a
cue (password, bearer and so on), whatever they are.  All others are outside by the model's own definition, so a text
falls into chains and each is decoded alone with the same result as the whole.  What this leaves out are secrets of
letters of one case, or of fewer than six letters and digits, far from any cue.

The field is trained by ``train``, by gradient ascent on sentences made by rule: secrets in the places where people leave
them, and numbers, names, paths and digests that are none.  Its weights are stored beside this file; running this module
makes them anew.
"""

from __future__ import annotations

import hashlib
import json
import random
import re
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import lean, texts

KINDS = ("assign", "access", "hex", "field")

_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_HINT = re.compile(r"pass|secret|token|api|key|pwd|auth|bearer|cred", re.I | re.A)
_TOKEN = re.compile(r"[A-Za-z0-9+/_.=~-]+|[^\sA-Za-z0-9+/_.=~-]")
_CUE = re.compile(r"(?:password|passwd|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|bearer|authorization|credentials?|auth)$", re.I | re.A)
_PREFIX = re.compile(r"(?:ghp|gho|ghs|glpat|sk|pk|rk|xox[abp]|pat|hf|npm|eyJ)[_-]|eyJ|AIza|SG\.")
_WEB = re.compile(r"www\.|\.(?:com|org|net|html?|php|pdf|png|jpe?g)\b|/", re.I)

_DIGIT, _MIXED = re.compile("[0-9]"), re.compile("[a-z][A-Z]")

BEGIN, INSIDE, OUTSIDE = 0, 1, 2
MARKS = frozenset("\"'`:=,;()[]{}<>")
#: Signs that stand within secrets, and words that stand between a cue and its secret.
GLUE, LINKS = frozenset("@!#$%^&*?"), frozenset("is was are the my your to for and of a in it".split())
#: How many tokens behind a cue are looked at.
NEAR = 8
#: Where the weights are stored.
STORED = Path(__file__).with_name("secret_field.json")


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the patterns' matches, by start and then kind."""
    found = []
    if _HINT.search(text):
        found += [(m.start(), "assign", m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), "access", m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), "hex", m.end()) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[1])))


def suspicious(token: str) -> bool:
    """Whether a token may be a secret wherever it stands: it has digits among letters, very many digits, or is long and of mixed case."""
    if len(token) < 6 or token.strip(".").isdigit() and len(token.strip(".")) < 20:
        return False
    return any(c.isdigit() for c in token) or len(token) >= 16 and token != token.lower() and token != token.upper() and not token.istitle()


def chains(tokens: list[str]) -> list[range]:
    """Runs of tokens that may belong to a secret: suspicious ones, and NEAR behind a cue."""
    out: list[range] = []
    cue = -NEAR - 1
    for i, t in enumerate(tokens):
        if i - cue <= NEAR or suspicious(t):
            if out and out[-1].stop == i:
                out[-1] = range(out[-1].start, i + 1)
            else:
                out.append(range(i, i + 1))
        if t[-1:].isalpha() and _CUE.search(t):
            cue = i
    return out


def _features(tokens: list[str], i: int, page: list[str]) -> list[str]:
    """Names of the features of token i: its shape, neighbours, the page's features."""
    t = tokens[i]
    n = len(t)
    behind = next((d for d in range(1, NEAR + 1) if i >= d and _CUE.search(tokens[i - d])), 0)
    back = " ".join("M" if x in MARKS else "S" if not x[0].isalnum() else x.lower() if x.lower() in LINKS else "W" for x in tokens[max(0, i - 2) : i])
    where = [f"cue {behind}", f"cue {min(behind, 1)}, back {back}", f"before {tokens[i - 1]}" if i and tokens[i - 1] in MARKS else "before other", f"after {tokens[i + 1]}" if i + 1 < len(tokens) and tokens[i + 1] in MARKS else "after other"]
    quotes = sum(x in "\"'`" for x in tokens[max(0, i - NEAR) : i]) % 2
    where += [f"quoted {quotes}, cue {min(behind, 1)}", f"glued {i > 0 and tokens[i - 1] in GLUE} {i + 1 < len(tokens) and tokens[i + 1] in GLUE}, cue {min(behind, 1)}"]
    if not t[0].isalnum() and n == 1:
        return [f"mark {t}", f"mark, quoted {quotes}", *where, *page]
    if t.lower() in LINKS:
        return [f"link {t.lower()}", f"link, quoted {quotes}", *where, *page]
    kinds = sum(bool(re.search(p, t)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[+/_=~-]"))
    turns = sum((a.isdigit() != b.isdigit()) or (a.isupper() != b.isupper()) for a, b in zip(t, t[1:])) / n
    out = [f"size{min(n // 4, 10)}", f"kinds{kinds}", f"turns{min(int(turns * 8), 5)}", f"varied{int(8 * len(set(t)) / n)}"]
    out += [name for name, p in (("hex", r"[0-9a-fA-F]+\Z"), ("digits", r"[0-9.+/-]+\Z"), ("lower", r"[a-z]+\Z"), ("words", r"[a-z]+(?:[_.-][a-z0-9]+)+\Z"), ("camel", r"[A-Za-z]+[0-9]{0,3}\Z")) if re.match(p, t)]
    out += [name for name, p in (("prefix", _PREFIX), ("web", _WEB)) if p.search(t)]
    out += [f"cue {min(behind, 1)}, {out[1]}", f"cue {min(behind, 1)}, {out[2]}", f"{out[0]}, {out[1]}, cue {min(behind, 1)}", f"{out[0]}, back {back}, cue {min(behind, 1)}"]
    return out + where + page


def page_features(text: str) -> list[str]:
    """Features of the whole text: code or prose, and whether it speaks of secrets."""
    return ["code" if re.search(r"[{};]\s*\n|\b(?:def|import|export|const|var|function|return)\b", text) else "prose", "hints" if _HINT.search(text) else "no hints"]


class Field:
    """Weights of features by tag, and of tags by the tag before (the last row: a chain's first tag)."""

    def __init__(self, weights: dict[str, np.ndarray], moves: np.ndarray) -> None:
        self.weights, self.moves = weights, moves

    def tags(self, rows: list[list[str]]) -> list[int]:
        """Viterbi over one chain; outside stands before and behind it."""
        none = np.zeros(3)
        best, back = None, []
        for names in rows:
            own = sum((self.weights.get(x, none) for x in names), none)
            if best is None:
                best = self.moves[OUTSIDE] + own
            else:
                step = best[:, None] + self.moves[:3]
                back.append(step.argmax(0))
                best = step.max(0) + own
        at = int((best + self.moves[:3, OUTSIDE]).argmax())
        out = [at]
        for b in reversed(back):
            at = int(b[at])
            out.append(at)
        return out[::-1]

    def spans(self, text: str) -> list[tuple[int, str, int]]:
        """Secrets that the field finds."""
        if not _DIGIT.search(text) and not _HINT.search(text) and not _MIXED.search(text):
            return []
        found = list(_TOKEN.finditer(text))
        tokens = [m[0] for m in found]
        page, out = page_features(text), []
        for chain in chains(tokens):
            begun = False
            for i, tag in zip(chain, self.tags([_features(tokens, i, page) for i in chain]), strict=True):
                if tag == INSIDE and begun:
                    out[-1] = (out[-1][0], "field", found[i].end())
                elif tag != OUTSIDE:
                    out.append((found[i].start(), "field", found[i].end()))
                begun = tag != OUTSIDE
        marks = "".join(MARKS - {"="})  # which ends some secrets
        cut = [(a + len(x) - len(x.lstrip(marks)), kind, b - len(x) + len(x.rstrip(marks))) for a, kind, b in out for x in [text[a:b]]]
        return [x for x in cut if x[0] < x[2]]


# --- training --------------------------------------------------------------------------------


def sentences(n: int = 700, seed: int = 7) -> list[tuple[str, list[str]]]:
    """Made-up texts with the secrets that stand in them."""
    r = random.Random(seed)
    low, up, dig = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    of = lambda letters, a, b: "".join(r.choice(letters) for _ in range(r.randint(a, b)))
    word = lambda: of(low, 2, 11)
    digit = lambda v: v if any(c.isdigit() for c in v) else v + r.choice(dig)
    glued = lambda: of(low + up, 2, 5) + r.choice("@!#$%&*") + of(low + up + dig, 2, 6) + r.choice(["", r.choice("!#$?") + of(dig, 1, 3)])
    values = [lambda: of(low + up + dig, 16, 44), lambda: of("0123456789abcdef", 24, 48), lambda: r.choice(["ghp_", "sk_live_", "xoxb-", "glpat-", "eyJ"]) + of(low + up + dig, 20, 40), lambda: of(low + up + dig + "+/", 24, 44) + "=", lambda: of(low, 4, 8) + of(dig, 2, 4) + of(up, 1, 2), lambda: of(low, 4, 8) + of(dig, 1, 3) + of(low, 0, 3) + of(dig, 0, 2), lambda: "AKIA" + of(up + dig, 16, 16)]
    cues = ["password", "passwd", "pwd", "passphrase", "secret", "token", "api_key", "apikey", "API_KEY", "access_key", "private_key", "credential"]
    plain = [
        lambda: of(dig, 6, 19), lambda: f"+1 ({of(dig, 3, 3)}) 555-{of(dig, 4, 4)}", lambda: f"{word()}.{of(dig, 2, 2)}@mail{of(dig, 1, 1)}.{word()}.com", lambda: ".".join(of(dig, 1, 3) for _ in range(4)), lambda: f"20{of(dig, 2, 2)}-0{of(dig, 1, 1)}-1{of(dig, 1, 1)}", lambda: f"https://{word()}.org/{word()}/{of(dig, 2, 6)}.html",
        lambda: f"{word()}_{word()}{of(dig, 1, 2)}", lambda: f"{word().capitalize()}{word().capitalize()}{of(dig, 1, 2)}", lambda: f"src/{word()}/{word()}{of(dig, 1, 1)}.py", lambda: f"version {of(dig, 1, 1)}.{of(dig, 1, 2)}.{of(dig, 1, 2)}-{word()}", lambda: f"{of(dig, 2, 4)}{of(low, 4, 6)}", lambda: word() + of(dig, 1, 3),
        lambda: f"the {r.choice(['token', 'secret', 'password'])} {word()} {word()}{of(dig, 1, 2)} is {word()}", lambda: f"a {r.choice(cues)} {r.choice(['is', 'was', 'for', 'of'])} {word()} {word()} and {word()}!", lambda: f"{r.choice(cues)}: the {word()} of {word()}", lambda: f"{word().capitalize()}{word().capitalize()}{word().capitalize()}", lambda: f"\"{word()} {word()} {word()}\"",
    ]
    out = []
    for _ in range(n):
        text, secrets = [], []
        for _ in range(r.randint(1, 4)):
            text.append(" ".join(word() for _ in range(r.randint(2, 8))))
            cue, x = r.choice(cues), r.random()
            if x < 0.3:
                value = digit(r.choice(values)())
                text.append(r.choice([f"{cue} = \"{value}\"", f"{cue}: {value}", f"{cue} is {value}", f"Authorization: Bearer {value}", f"export {cue.upper()}={value}", f"my {cue} {value}", value if len(value) > 22 else f"{cue}={value}"]))
            elif x < 0.4:
                value = of(low, 14, 26)  # letters only
                text.append(r.choice([f"{cue} is {value}", f"{cue}: {value}", f"my {cue} was '{value}'"]))
            elif x < 0.5:
                value = glued()
                text.append(r.choice([f"{cue} is {value}", f"{cue}: {value}", f"{cue} = \"{value}\""]))
            elif x < 0.55:
                value = " ".join(word() for _ in range(r.randint(3, 4)))  # several words, which only quotes hold together
                text.append(r.choice([f"{cue}: \"{value}\"", f"{cue} = '{value}'", f"the {cue} is \"{value}\""]))
            else:
                value = None
                text.append(r.choice(plain)())
            secrets += [value] if value else []
        out.append(("\n".join(text) if r.random() < 0.3 else " ".join(text), secrets))
    return out


def train(rounds: int = 120, ridge: float = 0.02) -> Field:
    """Penalised maximum likelihood by AdaGrad over all chains at once (forward and backward sums in log space)."""
    examples = []
    for text, secrets in sentences():
        found = list(_TOKEN.finditer(text))
        tokens, page = [m[0] for m in found], page_features(text)
        held, at = [], 0
        for value in secrets:  # they stand in this order
            at = text.index(value, at)
            held.append((at, at + len(value)))
        for chain in chains(tokens):
            now: list = []
            for i in chain:
                mine = next((h for h in held if found[i].start() < h[1] and h[0] < found[i].end()), None)
                first = mine is not None and (not now or now[-1][2] != mine)
                now.append((_features(tokens, i, page), OUTSIDE if mine is None else BEGIN if first else INSIDE, mine))
            examples += [now[k : k + 24] for k in range(0, len(now), 24)]  # long runs are rare; a cut costs one move
    names = sorted({x for c in examples for f, _, _ in c for x in f})
    index = {x: k for k, x in enumerate(names)}
    width = max(map(len, examples))
    most = max(len(f) for c in examples for f, _, _ in c)
    at = np.full((len(examples), width, most), len(names))
    gold, there = np.full((len(examples), width), OUTSIDE), np.zeros((len(examples), width), dtype=bool)
    for a, c in enumerate(examples):
        for b, (f, tag, _) in enumerate(c):
            at[a, b, : len(f)] = [index[x] for x in f]
            gold[a, b], there[a, b] = tag, True
    w, m = np.zeros((len(names) + 1, 3)), np.zeros((3, 3))
    sw, sm = np.full_like(w, 1e-6), np.full_like(m, 1e-6)
    forced = np.where(there[..., None], 0.0, np.array([-1e9, -1e9, 0.0]))  # behind a chain's end: outside
    sums = lambda x, axis: (top := x.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - top).sum(axis))
    for _ in range(rounds):
        own = w[at].sum(2) + forced
        ahead = [m[OUTSIDE] + own[:, 0]]
        for b in range(1, width):
            ahead.append(sums(ahead[-1][:, :, None] + m, 1) + own[:, b])
        behind = [np.broadcast_to(m[:, OUTSIDE], (len(examples), 3))]
        for b in range(width - 1, 0, -1):
            behind.append(sums(m[None] + (own[:, b] + behind[-1])[:, None, :], 2))
        behind = behind[::-1]
        total = sums(ahead[-1] + behind[-1], 1)
        share = np.exp(np.stack(ahead, 1) + np.stack(behind, 1) - total[:, None, None])
        gap = (np.eye(3)[gold] - share) * there[..., None]
        gw = np.zeros_like(w)
        for tag in range(3):
            gw[:, tag] = np.bincount(at.ravel(), np.repeat(gap[..., tag].ravel(), most), len(gw))
        gm = np.zeros_like(m)
        gm[OUTSIDE] += (np.eye(3)[gold[:, 0]] - share[:, 0]).sum(0)
        for b in range(1, width):
            pair = np.exp(ahead[b - 1][:, :, None] + m + (own[:, b] + behind[b])[:, None, :] - total[:, None, None])
            seen = np.zeros((len(examples), 3, 3))
            seen[np.arange(len(examples)), gold[:, b - 1], gold[:, b]] = 1
            gm += ((seen - pair) * there[:, b, None, None]).sum(0)
        gw -= ridge * w
        gm -= ridge * m
        gw[-1] = 0
        sw += gw * gw
        sm += gm * gm
        w += 0.5 * gw / np.sqrt(sw)
        m += 0.5 * gm / np.sqrt(sm)
    return Field({x: w[k] for x, k in index.items()}, m)


@cache
def trained() -> Field:
    """The stored field."""
    found = json.loads(STORED.read_text())
    return Field({k: np.array(v) for k, v in found["weights"].items()}, np.array(found["moves"]))


def write() -> None:
    """Trains the field and stores it; weights that are close to none are left out."""
    field = train()
    weights = {k: [round(float(x), 3) for x in v] for k, v in field.weights.items() if np.abs(v).max() > 0.01}
    STORED.write_text(json.dumps({"moves": field.moves.round(3).tolist(), "weights": weights}, indent=0, sort_keys=True) + "\n")


def _listed(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, kind, b in spans)


def scan(docs: DataFrame) -> DataFrame:
    """Secrets of every document.

    docs: doc_id, text; other columns are ignored.  Returns, one row per row of docs, doc_id, n_assign, n_access, n_hex
    (long), base_sha256 and spans (string; kind:start:end in code points, the field's spans among the base ones).  Spans
    of the field that lie within a base span aren't repeated.  A null or empty text has none; texts are scanned whole.
    """
    field = docs.sparkSession.sparkContext.broadcast(trained())

    def run(batches):
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                text = text or ""
                base = base_spans(text)
                more = [s for s in field.value.spans(text) if not any(a <= s[0] and s[2] <= b for a, _, b in base)]
                every = sorted([*base, *more], key=lambda s: (s[0], KINDS.index(s[1])))
                out.append((doc_id, *(sum(s[1] == k for s in base) for k in KINDS[:3]), hashlib.sha256(_listed(base).encode()).hexdigest(), _listed(every)))
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 4 + [pa.string()] * 2, strict=True)], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(run), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


if __name__ == "__main__":
    write()
