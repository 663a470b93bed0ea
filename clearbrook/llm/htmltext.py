"""HTML extraction with a recurrent block labeller.

A page is cut into its leaf blocks in page order. Each block is a vector: hashed names of
the tags, classes and ids on its path, hashed words, and a few figures (length, share of
linked text, place). A bidirectional LSTM in numpy reads the whole sequence, and every
block is labelled as article or not with the page as context.

The labeller is trained here, on a bounded sample of distinct pages (``MOST_PAGES`` and
``MOST_BYTES``, those of smallest hash). Its labels are read off pages that mark their article
with semantic tags: article or main, without what navigation, forms, asides and the like
enclose. Where no page has such tags, what lies outside of navigation and the like is taken
for the article. In training, paths are hidden at random, so that words, figures and
neighbours are learned for pages without such tags.

Reading a page takes time in proportion to its length, however odd its markup, and scoring
keeps a window of ``WINDOW`` blocks at a time, however many a page has.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import binary, map_arrow
from .words import U64, mix, words

PATH, WORD, FIGURES, HIDDEN, MOST_PAGES, MOST_BYTES, WINDOW = 64, 32, 6, 16, 400, 16 << 20, 1 << 13
WIDTH = PATH + WORD + FIGURES
# Element names of HTML.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr object math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mmultiscripts mprescripts mtable mtr mtd mstyle mspace mpadded mphantom menclose merror semantics annotation annotation-xml".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("script style noscript template svg iframe textarea title".split())
ASIDE = frozenset("nav aside footer header form button select option dialog menu".split())
ENDED = frozenset("li tr td th dt dd option".split())  # end where the next of their kind begins
_OPEN = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][\w:-]*))")
_STOP = re.compile(r"[>\"']|<[/a-zA-Z!]")
_NAME = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_ODD = re.compile(r"(?:^|[-_ ])(?:nav|navbar|menu|sidebar|side|ad|ads|advert|advertisement|banner|promo|sponsor|sponsored|cookie|cookies|consent|notice|alert|comment|comments|share|social|related|footer|header|subscribe|newsletter|signup|breadcrumb|breadcrumbs|popup|widget)(?:$|[-_ \d])", re.I)
_SPACES = re.compile(r"[\s\xa0]+")


def _tag_end(source: str, at: int) -> int:
    """Where the tag whose name ends at ``at`` ends (after its >), or -1.

    A quoted value ends at its quote. If that is missing, or is plainly the next value's (a > in
    between and = before it), the tag ends at its first >; before a further tag it ends at once.
    """
    while m := _STOP.search(source, at):
        if m[0] == ">":
            return m.end()
        if m[0][0] == "<":
            return m.start()
        close = source.find(m[0], m.end())
        if close < 0 or (source[close - 1] == "=" and source.find(">", m.end(), close) >= 0):
            gt = source.find(">", m.end())
            return gt + 1 if gt >= 0 else -1
        at = close + 1
    return -1


def tags(source: str):
    """(start, end, slash, name, attributes) of every piece of markup, in order; name is empty for comments and what is dropped whole."""
    at, last = 0, source.rfind(">")
    while m := _OPEN.search(source, at):
        start, name = m.start(), (m[2] or "").lower()
        if m[0] == "<!--":
            end = source.find("-->", m.end())
            end = end + 3 if end >= 0 else len(source)
        elif start > last:
            return  # no markup without a > to come, but for comments: those need none
        elif not name:
            end = source.find(">", m.end()) + 1
        else:
            end = _tag_end(source, m.end())
        if end < 0:
            at = m.end()
            continue
        attributes = source[m.end() : end].rstrip(">") if name else ""
        if name in DROPPED and not m[1]:
            if not (name == "svg" and attributes.endswith("/")):
                closing = re.compile(rf"</{name}\s*>", re.I).search(source, end)
                end = closing.end() if closing else len(source)
            name = ""
        yield start, end, m[1] or "", name, attributes
        at = end


@dataclass(slots=True)
class Block:
    path: bytes  # which slots of the path vector the names on its path have
    inside: bool | None  # in the article, as article and main tags say; None outside of any
    aside: bool  # within navigation and the like
    text: str
    linked: int  # characters within links


def teacher(page: list[Block]) -> list[bool]:
    """Article or not, as the page's own tags say."""
    tagged = any(b.inside is not None for b in page)
    return [bool(b.inside) if tagged else not b.aside for b in page]


def blocks(source: str) -> list[Block]:
    """Leaf blocks of a page with text: white space is one space, character references are decoded.

    Open elements are kept with what their path amounts to, so a block costs the same at any depth.
    """
    out: list[Block] = []
    # tag, slots, inside, aside, place of the closest element that isn't inline
    stack: list[tuple[str, tuple[int, ...], bool | None, bool, int]] = []
    open_: Counter[str] = Counter()
    held, present = [0] * PATH, bytearray(PATH)
    parts: list[str] = []
    linked = at = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = _SPACES.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                inside, aside = stack[-1][2:4] if stack else (None, False)
                out.append(Block(bytes(present), inside, aside, text, min(linked, len(text))))
            parts.clear()
        linked = 0

    def pop() -> str:
        tag, slots, *_ = stack.pop()
        open_[tag] -= 1
        for k in slots:
            held[k] -= 1
            present[k] = held[k] > 0
        return tag

    for start, end, slash, tag, attributes in tags(source):
        if start > at:
            parts.append(source[at:start])
            linked += start - at if open_["a"] else 0
        at = end
        if not tag:
            continue
        inline = tag in INLINE
        if not inline:
            flush()
        elif tag == "br":
            parts.append(" ")
        if slash:
            if open_[tag]:
                while pop() != tag:
                    pass
            continue
        if not inline and stack and (i := stack[-1][4]) >= 0 and (stack[i][0] == "p" or (stack[i][0] == tag and tag in ENDED)):
            # an open paragraph, and inline tags left open in it, end at the next block; so do list items and cells at their next
            while len(stack) > i:
                pop()
        if tag not in VOID and not attributes.endswith("/"):
            inside, aside, closest = stack[-1][2:] if stack else (None, False, -1)
            slots: tuple[int, ...] = ()
            if not inline:
                names = [x.lower() for m in _NAME.findall(attributes) for x in "".join(m).split()]
                odd = tag in ASIDE or any(map(_ODD.search, names))
                inside = True if inside is None and tag in ("article", "main") else inside
                inside, aside, closest = inside and not odd, aside or odd, len(stack)
                slots = tuple(_slot(n) for n in (tag, *("." + x for x in names)) if n not in ("html", "body"))
                for k in slots:
                    held[k] += 1
                    present[k] = 1
            stack.append((tag, slots, inside, aside, closest))
            open_[tag] += 1
    if at < len(source):
        parts.append(source[at:])
    flush()
    return out


_slots: dict[str, int] = {}


def _slot(name: str) -> int:
    """Place of a path name in the vector."""
    if name not in _slots:
        if len(_slots) > 100_000:
            _slots.clear()
        value = np.frombuffer(name.encode().ljust(8, b"\0")[:8], U64)[0] + U64(len(name)) * U64(0x9E3779B97F4A7C15 & 0xFFFF)
        _slots[name] = int(mix(np.array([value]))[0] % U64(PATH))
    return _slots[name]


def vectors(pages: list[list[Block]], first: int = 0, size: int | None = None) -> np.ndarray:
    """A row per block, pages one after the other; ``first`` and ``size`` place the only page's blocks in a longer page."""
    flat = [b for p in pages for b in p]
    x = np.zeros((len(flat), WIDTH), np.float32)
    if flat:
        x[:, :PATH] = np.frombuffer(b"".join(b.path for b in flat), np.uint8).reshape(-1, PATH)
    n = 0
    for w in words(pa.array([b.text for b in flat], pa.string())):
        slot = (w.hashes(lower=True) % U64(WORD)).astype(np.int64)
        bag = np.bincount(w.owner() * WORD + slot, minlength=w.rows * WORD).reshape(w.rows, WORD)
        x[n : n + w.rows, PATH : PATH + WORD] = bag / np.maximum(w.counts(), 1)[:, None]
        x[n : n + w.rows, -FIGURES] = np.log1p(w.counts()) / 5
        n += w.rows
    i = 0
    for p in pages:
        all_ = size or len(p)
        for k, b in enumerate(p, first):
            x[i, 1 - FIGURES :] = (b.linked / len(b.text), k / all_, 1 / (1 + k), 1 / (all_ - k), b.text[-1] in ".!?:;\"'»”)")
            i += 1
    return x


class Labeller:
    """Bidirectional LSTM with a logistic output on both states and the input."""

    def __init__(self, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        self.p = {f"{k}{d}": v for d in "fb" for k, v in (("x", rng.normal(0, WIDTH**-0.5, (WIDTH, 4 * HIDDEN))), ("h", rng.normal(0, HIDDEN**-0.5, (HIDDEN, 4 * HIDDEN))), ("b", np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN)))}
        self.p |= {"out": rng.normal(0, 0.1, (2 * HIDDEN, 1)), "skip": np.zeros((WIDTH, 1)), "bias": np.zeros(1)}

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, state: tuple | None = None, kept: list | None = None) -> tuple[np.ndarray, tuple]:
        """States over time of one direction, and the last; padded places keep the state. What training needs goes into ``kept``."""
        n, t, _ = x.shape
        gates = x @ self.p[f"x{d}"] + self.p[f"b{d}"]
        h, c = state or (np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN)))
        states = np.zeros((n, t, HIDDEN))
        for k in range(t) if d == "f" else range(t - 1, -1, -1):
            a = gates[:, k] + h @ self.p[f"h{d}"]
            s = 1 / (1 + np.exp(-np.clip(a[:, : 3 * HIDDEN], -30, 30)))
            i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
            g = np.tanh(a[:, 3 * HIDDEN :])
            m = mask[:, k : k + 1]
            new = f * c + i * g
            tc = np.tanh(new)
            if kept is not None:
                kept.append((k, h, c, i, f, o, g, tc, m))
            c = m * new + (1 - m) * c
            h = m * o * tc + (1 - m) * h
            states[:, k] = h
        return states, (h, c)

    def forward(self, x: np.ndarray, mask: np.ndarray, kept: tuple[list, list] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities, and the states of both directions."""
        both = np.concatenate([self._run(x, mask, d, None, kept and kept[i])[0] for i, d in enumerate("fb")], 2)
        z = (both @ self.p["out"] + x @ self.p["skip"])[..., 0] + self.p["bias"]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30))), both

    def long(self, page: list[Block]) -> np.ndarray:
        """Probabilities of the blocks of one long page, by windows: backwards, then forwards; of the first way one figure a block is kept."""
        z, starts = np.zeros(len(page)), range(0, len(page), WINDOW)
        for d, part, order in (("b", slice(HIDDEN, None), reversed(starts)), ("f", slice(None, HIDDEN), starts)):
            state = None
            for i in order:
                x = vectors([page[i : i + WINDOW]], i, len(page)).astype(float)[None]
                states, state = self._run(x, np.ones(x.shape[:2]), d, state)
                z[i : i + WINDOW] += (states[0] @ self.p["out"][part])[:, 0] + ((x[0] @ self.p["skip"])[:, 0] + self.p["bias"] if d == "f" else 0)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        kept: tuple[list, list] = [], []
        p, both = self.forward(x, mask, kept)
        dz = ((p - y) * mask / mask.sum())[..., None]
        flat = x.reshape(-1, WIDTH)
        out = {"out": both.reshape(-1, 2 * HIDDEN).T @ dz.reshape(-1, 1), "skip": flat.T @ dz.reshape(-1, 1), "bias": dz.sum((0, 1))}
        states = dz @ self.p["out"].T
        for d, steps, ds in (("f", kept[0], states[..., :HIDDEN]), ("b", kept[1], states[..., HIDDEN:])):
            da_all = np.zeros((*x.shape[:2], 4 * HIDDEN))
            dh, dc, gh = np.zeros_like(ds[:, 0]), np.zeros_like(ds[:, 0]), np.zeros_like(self.p[f"h{d}"])
            for k, h, c, i, f, o, g, tc, m in reversed(steps):
                dh = dh + ds[:, k]
                dn, do = m * dh, m * dh * tc
                dcn = m * dc + dn * o * (1 - tc**2)
                da = np.concatenate([dcn * g * i * (1 - i), dcn * c * f * (1 - f), do * o * (1 - o), dcn * i * (1 - g**2)], 1)
                da_all[:, k] = da
                gh += h.T @ da
                dh = (1 - m) * dh + da @ self.p[f"h{d}"].T
                dc = (1 - m) * dc + dcn * f
            out |= {f"x{d}": flat.T @ da_all.reshape(-1, 4 * HIDDEN), f"h{d}": gh, f"b{d}": da_all.sum((0, 1))}
        return out


def padded(x: np.ndarray, bounds: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple]:
    """The pages ``own`` as one array over time, its mask, and where its real places are."""
    length = bounds[own + 1] - bounds[own]
    t = np.arange(length.max())
    mask = (t < length[:, None]).astype(float)
    real = np.nonzero(mask)
    out = np.zeros((len(own), len(t), x.shape[1]))
    out[real] = x[bounds[own][real[0]] + real[1]]
    return out, mask, real


def train_labeller(x: np.ndarray, y: np.ndarray, bounds: np.ndarray, rounds: int = 12, batch: int = 32, rate: float = 0.02, seed: int = 5) -> Labeller:
    """Adam on the logistic loss over whole pages; of a third of the pages the paths are hidden."""
    model, rng = Labeller(), np.random.default_rng(seed)
    m, v, step = ({k: np.zeros_like(p) for k, p in model.p.items()} for _ in range(2)), None, 0
    m, v = m
    some = np.flatnonzero(np.diff(bounds) > 0)
    for _ in range(rounds):
        order = rng.permutation(some)
        for i in range(0, len(order), batch):
            own = order[i : i + batch]
            own = own[np.argsort(np.diff(bounds)[own], kind="stable")]
            px, mask, real = padded(x, bounds, own)
            px[:, :, :PATH] *= (rng.random((len(own), 1, 1)) > 0.34).astype(float)
            py = np.zeros(mask.shape)
            py[real] = y[bounds[own][real[0]] + real[1]]
            step += 1
            for k, g in model.gradients(px, mask, py).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g**2
                model.p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return model


def label_pages(model: Labeller, pages: list[list[Block]]) -> list[np.ndarray]:
    """Probabilities of each page's blocks; pages of like length are read together, long ones by themselves."""
    out = [np.zeros(len(p)) for p in pages]
    order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
    i = 0
    while i < len(order) and len(pages[order[i]]) <= WINDOW:
        j = i + 1
        while j < len(order) and (j - i + 1) * len(pages[order[j]]) <= WINDOW:
            j += 1
        some = [pages[k] for k in order[i:j]]
        x, mask, real = padded(vectors(some), np.cumsum([0, *map(len, some)]), np.arange(len(some)))
        p = model.forward(x, mask)[0]
        for row, k in enumerate(order[i:j]):
            out[k] = p[row, : len(pages[k])]
        i = j
    for k in order[i:]:
        out[k] = model.long(pages[k])
    return out


def train(pages: DataFrame, most_pages: int = MOST_PAGES, most_bytes: int = MOST_BYTES) -> Labeller | None:
    """A labeller fitted to a sample of distinct pages, with semantic tags if any page has them; None if no page has text."""
    rows = pages.where("html <> ''").select(F.xxhash64("page_id", "html").alias("draw"), "html")
    for sample in (rows.where("html rlike '(?i)<(article|main)\\\\b'"), rows):
        chosen = sample.select("draw", F.octet_length("html").alias("size")).distinct().orderBy("draw", "size").limit(most_pages).collect()
        upto = np.cumsum([r["size"] for r in chosen])
        chosen = [(r["draw"],) for r, total in zip(chosen, upto, strict=True) if total <= most_bytes or total == r["size"]]
        if chosen:
            break
    else:
        return None

    def send(batch):
        found = [f for s in batch.column(1).to_pylist() if (f := blocks(s))]
        if found:
            bounds = np.cumsum([0, *map(len, found)])
            yield {"x": binary(vectors(found).ravel(), bounds * WIDTH), "y": binary(np.array([y for f in found for y in teacher(f)], np.uint8), bounds)}

    picked = sample.join(F.broadcast(pages.sparkSession.createDataFrame(chosen, "draw long")), "draw").dropDuplicates(["draw"])
    found = sorted((bytes(r["x"]), bytes(r["y"])) for r in map_arrow(picked, "x binary, y binary", send).collect())
    if not found:
        return None
    xs, ys = ([np.frombuffer(r[i], k) for r in found] for i, k in ((0, np.float32), (1, np.uint8)))
    return train_labeller(np.concatenate(xs).reshape(-1, WIDTH), np.concatenate(ys).astype(float), np.cumsum([0, *map(len, ys)]))


def extract(pages: DataFrame, model: Labeller | None = None) -> DataFrame:
    """A row per input row: page_id, url, text (article blocks joined by a line feed), n_chars.

    Takes page_id, url and html; other columns are ignored. Null and empty html give an empty text,
    and so does an empty table an empty result. Malformed markup is read as far as it goes; very
    long pages are labelled by windows. Repeated rows give equal texts, and the sample that a
    labeller is trained on has each page once. Without a model one is trained on the pages
    themselves.
    """
    held = pages.sparkSession.sparkContext.broadcast(model or train(pages))

    def run(batch: pa.RecordBatch):
        ids, urls, sources = (batch.column(i) for i in range(3))
        done, i = [], 0
        while i < len(sources):  # a few MB of html at a time
            j, size = i, 0
            while j < len(sources) and (j == i or size < 4 << 20):
                size += len(sources[j].as_py() or "")
                j += 1
            found = [blocks(s.as_py() or "") for s in sources[i:j]]
            likely = label_pages(held.value, found) if held.value else [np.zeros(len(f)) for f in found]
            done += ["\n".join(b.text for b, p in zip(f, ps, strict=True) if p >= 0.5) for f, ps in zip(found, likely, strict=True)]
            i = j
        yield {"page_id": ids, "url": urls, "text": pa.array(done, pa.string())}

    out = map_arrow(pages.select("page_id", F.col("url").cast("string").alias("url"), "html"), f"page_id {dict(pages.dtypes)['page_id']}, url string, text string", run)
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def query(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
