"""Main text of web pages: a recurrent labeller decides for every text block with the whole page as context."""

from __future__ import annotations

import html
import random
import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from seriesframe.llm.sharing import received, sent
from seriesframe.llm.words import in_pieces

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hr html label legend li main nav ol option p pre section select summary table tbody td "
    "textarea tfoot th thead tr ul".split()
)
UNSEEN = frozenset("script style noscript template head title svg iframe canvas annotation annotation-xml".split())
#: What a head can hold; any other element, and text, is the body's.
HEAD = frozenset("base basefont bgsound link meta title style script noscript template noframes head html".split())
#: What a new block ends if it is still open.
_ROWS = {"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}
ENDS = {"thead": _ROWS, "tbody": _ROWS, "tfoot": _ROWS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

PIECES = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|textarea|title|iframe)\b(?P<rawattrs>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)>(?P<body>.*?)(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|<[!?/][^>]*(?:>|\Z)",
    re.I | re.S,
)
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
PARTS = re.compile(r"[a-z]+")

PATH_SLOTS, WORD_SLOTS, NUMBERS = 128, 16, 6
INPUTS, HIDDEN = PATH_SLOTS + WORD_SLOTS + NUMBERS, 16
#: Made-up labelled pages of the training set, passes over them, pages of a step, and the step size.
PAGES, EPOCHS, BATCH, RATE = 1_200, 14, 32, 0.01
#: Marks the label in made-up text; a code point for private use.
MARK = "\ue000"
#: Words and paths kept in a task's memo.
MEMO = 200_000


@dataclass
class Block:
    """A run of text between block boundaries, with the elements that hold it."""

    path: str
    texts: list[str] = field(default_factory=list)
    linked: int = 0

    @property
    def text(self) -> str:
        return " ".join("".join(self.texts).split())


def _names(attrs: str) -> str:
    """Words of class, id and role, each after a dot."""
    return " ".join("." + w for value in NAMES.findall(attrs) for w in PARTS.findall(value.lower())) if attrs else ""


def blocks_of(page: str | None) -> list[Block]:
    """Blocks of visible text in page order. Broken markup is read leniently: missing ends are added, stray ones ignored.

    Text and elements of the body end a head that is still open. Unseen elements without an end of their own hide what
    follows only up to the next block; which these are shows when the page has been read once.
    """
    out, unended = _walk(page or "", frozenset())
    return _walk(page or "", unended)[0] if unended else out


def _walk(page: str, unended: frozenset[int]) -> tuple[list[Block], frozenset[int]]:
    """Blocks, and where the unseen elements start that something else than their own end tag ended."""
    out, stack, at = [], [], 0
    current: Block | None = None
    open_at: list[int] = []  # beside the stack: where its elements start
    lost: set[int] = set()

    def cut(k: int) -> None:
        lost.update(o for (t, _), o in zip(stack[k:], open_at[k:]) if t in UNSEEN and t != "head")
        del stack[k:], open_at[k:]

    def say(text: str) -> None:
        nonlocal current
        if stack and stack[-1][0] == "head" and text and not text.isspace():
            cut(len(stack) - 1)
        if not text or any(t in UNSEEN for t, _ in stack):
            return
        if current is None:
            if text.isspace():
                return
            current = Block("/".join(t + n for t, n in stack))
            out.append(current)
        text = html.unescape(text)
        current.texts.append(text)
        current.linked += len(text) if any(t == "a" for t, _ in stack) else 0

    for m in PIECES.finditer(page):
        say(page[at : m.start()])
        at = m.end()
        if m["raw"]:
            if m["raw"].lower() == "textarea":
                current = None
                if stack and stack[-1][0] == "head":
                    cut(len(stack) - 1)
                stack.append(("textarea", _names(m["rawattrs"])))
                say(m["body"])
                stack.pop()
                current = None
            continue
        if not m["tag"]:
            continue
        tag = m["tag"].lower()
        if tag == "br":
            say(" ") if current else None
            continue
        if tag in BLOCK:
            current = None
        if m["end"]:
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), None)
            if k is not None:
                cut(k + 1)
                del stack[k:], open_at[k:]
            continue
        if tag == "body":
            k = next((k for k, (t, _) in enumerate(stack) if t == "head"), None)
            if k is not None and all(t != "template" or o in unended for (t, _), o in zip(stack[k:], open_at[k:])):
                cut(k)
        if tag in BLOCK:
            k = next((k for k, o in enumerate(open_at) if o in unended), None)
            if k is not None:
                cut(k)
        if tag not in HEAD and stack and stack[-1][0] == "head":
            cut(len(stack) - 1)
        if tag in BLOCK:
            ended = ENDS.get(tag, set()) | {"p"}
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in ended:
                    cut(k)
                elif stack[k][0] in BLOCK or stack[k][0] in UNSEEN:
                    break
        if tag not in VOID and not m["attrs"].endswith("/"):
            stack.append((tag, _names(m["attrs"])))
            open_at.append(m.start())
    say(page[at:])
    cut(0)
    return [b for b in out if b.text], frozenset(lost)


class Vectors:
    """Input vectors of blocks; paths and words are hashed into fixed numbers of slots."""

    def __init__(self) -> None:
        self.paths: dict[str, np.ndarray] = {}
        self.words: dict[str, int] = {}

    def path(self, path: str) -> np.ndarray:
        found = self.paths.get(path)
        if found is None:
            if len(self.paths) >= MEMO:
                self.paths.clear()
            found = np.zeros(PATH_SLOTS)
            for step in path.split("/"):
                tag, *names = step.replace(" ", "").split(".")
                for item in {"<" + tag, *names}:
                    h = zlib.crc32(item.encode())
                    for k in (h % PATH_SLOTS, h // PATH_SLOTS % PATH_SLOTS):  # two slots, so few items share both
                        found[k] += 1.0
            self.paths[path] = found = np.minimum(found, 2.0)
        return found

    def word(self, word: str) -> int:
        found = self.words.get(word)
        if found is None:
            if len(self.words) >= MEMO:
                self.words.clear()
            self.words[word] = found = zlib.crc32(word.lower().encode()) % WORD_SLOTS
        return found

    def block(self, block: Block, place: float) -> np.ndarray:
        text = block.text
        words = text.split(" ")
        bag = np.bincount([self.word(w) for w in words], minlength=WORD_SLOTS) / len(words)
        numbers = [
            np.log1p(len(words)) / 4,
            min(1.0, block.linked / max(1, len(text))),
            place,
            min(1.0, 10 * sum(map(text.count, ".,;!?")) / len(text)),
            min(1.0, len(text) / len(words) / 10),
            float(block.linked > 0),
        ]
        return np.concatenate([self.path(block.path), bag, numbers])

    def page(self, blocks: list[Block]) -> np.ndarray:
        return np.array([self.block(b, k / len(blocks)) for k, b in enumerate(blocks)], np.float32).reshape(-1, INPUTS)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Bidirectional LSTM with one output per block. Pages are laid side by side, longest first."""

    def __init__(self) -> None:
        rng = np.random.default_rng(9)
        draw = lambda *shape: (rng.normal(size=shape) / np.sqrt(shape[0])).astype(np.float32)
        self.w = {}
        for d in "fb":
            self.w |= {f"x{d}": draw(INPUTS, 4 * HIDDEN), f"h{d}": draw(HIDDEN, 4 * HIDDEN), f"c{d}": np.zeros(4 * HIDDEN, np.float32)}
            self.w[f"c{d}"][HIDDEN : 2 * HIDDEN] = 1  # remember at first
        self.w |= {"o": draw(2 * HIDDEN, 1), "oc": np.zeros(1, np.float32)}

    @staticmethod
    def layout(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of a (time, page) grid for pages sorted by falling length: pages that reach each time, and where each
        page's blocks stand in time order, forwards and backwards."""
        active = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")
        starts = np.cumsum(active) - active
        ahead = np.concatenate([starts[:n] + k for k, n in enumerate(lengths)])
        back = np.concatenate([starts[:n][::-1] + k for k, n in enumerate(lengths)])
        return active, ahead, back

    def run(self, x: np.ndarray, active: np.ndarray, d: str, keep: bool = False):
        """Hidden states for rows in time order."""
        given = x @ self.w[f"x{d}"] + self.w[f"c{d}"]
        h = c = np.zeros((int(active[0]), HIDDEN), np.float32)
        out, gates, cells, at = np.empty((len(x), HIDDEN), np.float32), [], [], 0
        for n in active.tolist():
            z = given[at : at + n] + h[:n] @ self.w[f"h{d}"]
            g = _sigmoid(z[:, : 3 * HIDDEN])
            i, f, o = g[:, :HIDDEN], g[:, HIDDEN : 2 * HIDDEN], g[:, 2 * HIDDEN :]
            u = np.tanh(z[:, 3 * HIDDEN :])
            if keep:
                gates.append((i, f, o, u, c[:n], h[:n]))
            c = f * c[:n] + i * u
            t = np.tanh(c)
            h = o * t
            if keep:
                cells.append(t)
            out[at : at + n] = h
            at += n
        return (out, gates, cells) if keep else out

    def backward(self, x, active, d, gates, cells, dout, grads) -> None:
        wh = self.w[f"h{d}"]
        starts = np.cumsum(active) - active
        dh, dc = np.zeros((int(active[0]), HIDDEN), np.float32), np.zeros((int(active[0]), HIDDEN), np.float32)
        dz_all = np.empty((len(x), 4 * HIDDEN), np.float32)
        for k in range(len(active) - 1, -1, -1):
            n, at = int(active[k]), int(starts[k])
            i, f, o, u, c, h = gates[k]
            t = cells[k]
            g = dh[:n] + dout[at : at + n]
            gc = dc[:n] + g * o * (1 - t * t)
            dz = np.hstack([gc * u * i * (1 - i), gc * c * f * (1 - f), g * t * o * (1 - o), gc * i * (1 - u * u)])
            dz_all[at : at + n] = dz
            grads[f"h{d}"] += h.T @ dz
            dh[:n], dc[:n] = dz @ wh.T, gc * f
        grads[f"x{d}"] += x.T @ dz_all
        grads[f"c{d}"] += dz_all.sum(axis=0)

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Probability of main text for each block of each page."""
        out: list = [np.empty(0)] * len(pages)
        order = sorted((k for k, p in enumerate(pages) if len(p)), key=lambda k: -len(pages[k]))
        if not order:
            return out
        lengths = np.array([len(pages[k]) for k in order])
        active, ahead, back = self.layout(lengths)
        x = np.concatenate([pages[k] for k in order])
        states = []
        for d, place in (("f", ahead), ("b", back)):
            laid = np.empty_like(x)
            laid[place] = x
            states.append(self.run(laid, active, d)[place])
        p = _sigmoid(np.hstack(states) @ self.w["o"] + self.w["oc"])[:, 0]
        for k, part in zip(order, np.split(p, np.cumsum(lengths)[:-1])):
            out[k] = part
        return out

    def fit(self, pages: list[np.ndarray], labels: list[np.ndarray]) -> Labeller:
        """Back-propagation through time over whole pages, Adam steps."""
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        v = {k: np.zeros_like(x) for k, x in self.w.items()}
        rng, step = np.random.default_rng(99), 0
        for _ in range(EPOCHS):
            for own in np.array_split(rng.permutation(len(pages)), max(1, len(pages) // BATCH)):
                own = sorted(own.tolist(), key=lambda k: -len(pages[k]))
                lengths = np.array([len(pages[k]) for k in own])
                active, ahead, back = self.layout(lengths)
                x, y = np.concatenate([pages[k] for k in own]), np.concatenate([labels[k] for k in own])
                runs, states = [], []
                for d, place in (("f", ahead), ("b", back)):
                    laid = np.empty_like(x)
                    laid[place] = x
                    runs.append((laid, *self.run(laid, active, d, keep=True)))
                    states.append(runs[-1][1][place])
                both = np.hstack(states)
                error = (_sigmoid(both @ self.w["o"] + self.w["oc"])[:, 0] - y)[:, None].astype(np.float32) / len(y)
                grads = {k: np.zeros_like(w) for k, w in self.w.items()}
                grads["o"], grads["oc"] = both.T @ error, error.sum(axis=0)
                dboth = error @ self.w["o"].T
                for (d, place), (laid, _, gates, cells), part in zip((("f", ahead), ("b", back)), runs, np.hsplit(dboth, 2)):
                    dout = np.empty_like(part)
                    dout[place] = part
                    self.backward(laid, active, d, gates, cells, dout, grads)
                step += 1
                for k, g in grads.items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.w[k] -= (RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self


# Names that page authors give to parts of a page, and phrases found in them.
MAIN_NAMES = "content article post entry story main body text page blog news single prose article-body post-content entry-content main-content".split()
SIDE_NAMES = {
    "nav": "nav menu navbar topnav navigation breadcrumb breadcrumbs pagination pager tabs toc mainmenu",
    "header": "header masthead topbar site-header branding logo banner-top page-header",
    "footer": "footer site-footer bottom copyright legal colophon page-footer",
    "aside": "sidebar aside widget related recommended popular trending archive tags tagcloud rail right-column",
    "notice": "cookie consent notice gdpr alert popup modal overlay disclaimer paywall subscribe newsletter signup banner cookie-banner",
    "ad": "ad ads advert advertisement sponsored promo banner promotion adsense sponsor ad-slot partner",
    "form": "form search login contact signup register search-form feedback",
    "comments": "comments comment replies reply discussion respond thread disqus user-comments comment-list reviews",
    "share": "share social follow author-bio byline-links toolbar buttons",
}
PHRASES = {
    "nav": "home about contact products services blog archive login",
    "header": "welcome to our site home search",
    "footer": "copyright all rights reserved privacy policy terms of use imprint contact",
    "aside": "related articles most read popular posts tags categories",
    "notice": "we use cookies accept all decline subscribe to our newsletter",
    "ad": "advertisement sponsored buy now sale offer click here",
    "form": "name email message send submit search password",
    "comments": "reply says posted by comments leave a comment great post thanks",
    "share": "share on facebook twitter follow us print email",
}


def made_up_page(rng: random.Random) -> list[tuple[str, int]]:
    """A page as (markup, label of the text in it): 1 for the article, 0 for what stands around it."""
    syllables = ["".join(rng.choices("aeioustrnlmdhgp", k=rng.randint(2, 4))) for _ in range(60)]

    def words(low: int, high: int) -> str:
        out = ["".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(rng.randint(low, high))]
        return " ".join(out).capitalize() + rng.choice([".", ".", ".", ".", "", "!", "?"])

    def small(kind: str) -> str:
        phrase = PHRASES[kind].split()
        own = " ".join(rng.sample(phrase, min(len(phrase), rng.randint(1, 6))))
        return rng.choice([own, words(1, 8), words(1, 8), words(6, 30), f"&copy; {words(3, 12)}" if kind == "footer" else own])

    def named(names: list[str]) -> str:
        name = rng.choice(names) + rng.choice(["", "", " wrap", " box", " inner", "-wrap", "-box", "-area"])
        return f' {rng.choice(["class", "class", "id"])}="{name}"'

    def side(kind: str) -> list[tuple[str, int]]:
        tag = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}.get(kind, "div")
        if rng.random() < 0.35:
            tag = rng.choice(["div", "section"]) if kind != "form" else "form"
        bare = tag not in ("div", "section") and rng.random() < 0.6
        style = {"nav": 0, "comments": 1, "form": 3}.get(kind, rng.choice([0, 1, 2, 2]))
        out = [(f"<{tag}{'' if bare else named(SIDE_NAMES[kind].split())}>", 0)]
        for _ in range(rng.randint(1, 7) if style != 2 else 1):
            if style == 0:
                out.append((f'<ul><li><a href="#">{small(kind)}</a></li></ul>', 0))
            elif style == 1:
                inner = named(SIDE_NAMES[kind].split()) if rng.random() < 0.6 else ""
                out.append((f"<div{inner}><p>{words(4, 60) if kind == 'comments' else small(kind)}</p></div>", 0))
            elif style == 2:
                out.append((small(kind), 0))
            else:
                field = rng.choice(["<select><option>{}</option></select>", "<textarea>{}</textarea>", "<legend>{}</legend>", "<p>{}</p>", "{}"])
                out.append((f"<label>{small(kind)}</label>{field.format(small(kind))}<button>{small(kind)}</button>", 0))
        return [*out, (f"</{tag}>", 0)]

    def story() -> list[tuple[str, int]]:
        out = [(f"<h1>{words(3, 12)}</h1>", 1)] if rng.random() < 0.85 else []
        for _ in range(rng.randint(1, 15)):
            kind = rng.random()
            long = words(8, 120) if rng.random() < 0.7 else words(1, 8)
            if kind < 0.68:
                out.append((f"<p>{long}</p>" if rng.random() < 0.8 else f"<p><b>{long}<br>", 1))
            elif kind < 0.76:
                out.append((f"<h2>{words(1, 8)}</h2>", 1))
            elif kind < 0.83:
                out.append((f"<ul><li>{words(2, 25)}</li><li>{words(2, 25)}</li></ul>", 1))
            elif kind < 0.87:
                out.append((f"<blockquote>{long}</blockquote>", 1))
            elif kind < 0.90:
                out.append((f"<table><tr><td>{words(1, 5)}</td><td>{words(1, 5)}</td></tr></table>", 1))
            elif kind < 0.92:
                out.append((f"<pre>{long}</pre>", 1))
            elif kind < 0.94:
                out.append((f'<p><a href="#">{words(2, 12)}</a> {words(2, 20)}</p>', 1))
            else:
                out += side(rng.choice(["ad", "share", "aside", "notice", "form"]))
        return out

    page: list[tuple[str, int]] = []
    for kind in ("notice", "header", "nav", "ad", "share"):
        page += side(kind) if rng.random() < (0.7 if kind == "nav" else 0.45) else []
    style = rng.random()
    if style < 0.6:
        wrap = "<article>" if rng.random() < 0.6 else f"<article{named(MAIN_NAMES)}>", "</article>"
    elif style < 0.75:
        wrap = ("<main>", "</main>") if rng.random() < 0.5 else ("<main><article>", "</article></main>")
    else:
        tag = rng.choice(["div", "div", "section"])
        wrap = f"<{tag}{named(MAIN_NAMES)}>", f"</{tag}>"
    page += [(wrap[0], 0), *story()]
    if rng.random() < 0.2:
        page += side("comments")
    page += [(wrap[1], 0)]
    for kind in ("share", "comments", "aside", "ad", "form", "notice", "footer"):
        page += side(kind) if rng.random() < (0.75 if kind == "footer" else 0.35) else []
    return page


def trained_labeller() -> Labeller:
    """Trains on PAGES made-up pages; nothing of it depends on the data, so it is the same on every run."""
    rng, vectors, pages, labels = random.Random(2_024), Vectors(), [], []
    for _ in range(PAGES):
        parts = made_up_page(rng)
        # Each piece of text starts with a mark and its label; the first mark in a block is the block's label.
        marked = "".join(re.sub(r"(>|^)([^<]+)", lambda m, y=y: f"{m[1]}{MARK}{y}{m[2]}", text) for text, y in parts)
        found = blocks_of(f"<html><head><title>t</title></head><body>{marked}</body></html>")
        y = np.array([int(b.text[b.text.index(MARK) + 1]) for b in found])
        for b in found:
            b.texts = [re.sub(MARK + "[01]", "", "".join(b.texts))]
        keep = [k for k, b in enumerate(found) if b.text]
        if keep:
            pages.append(vectors.page([found[k] for k in keep]))
            labels.append(y[keep])
    return Labeller().fit(pages, labels)


def _extractor(shared) -> Callable:
    def extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, vectors = received(shared), Vectors()
        for batch in in_pieces(batches, 256):
            pages = [blocks_of(p) for p in batch.column(2).to_pylist()]
            chances = model.label([vectors.page(b) if b else np.empty((0, INPUTS), np.float32) for b in pages])
            texts = ["\n".join(b.text for b, p in zip(blocks, chance) if p >= 0.5) for blocks, chance in zip(pages, chances)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return extract


def main_texts(pages: DataFrame, model: Labeller | None = None) -> DataFrame:
    """One row per row of ``pages``: ``page_id``, ``url``, ``text``, ``n_chars`` (code points).

    The page is cut into blocks of visible text; a bidirectional LSTM reads each block's element path and names, hashed
    words and a few numbers, in page order, and labels all of them. Blocks labelled as main text are joined by a line
    feed. Character references are decoded and white space inside a block becomes one space.

    Null and empty pages, and pages without main text, have an empty text. Pages of any length are read whole. Repeated
    rows and null ids are carried through; other columns are not read. Nothing is shuffled. The labeller is trained on
    made-up pages of the usual layouts, a fixed number of them.
    """
    spark = pages.sparkSession
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    shared = sent(spark, model or trained_labeller())
    return pages.mapInArrow(_extractor(shared), "page_id long, url string, text string, n_chars long")
