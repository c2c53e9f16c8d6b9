"""Personal data: patterns, and a skip-chain conditional random field that adds consistent spans."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegauge.llm.common import sliced, table, with_columns

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
MARK = re.compile(r"[0-9@]")
BLANK = re.compile(r"[\x20\x09-\x0D]")
BLANKS = "\x20\t\n\x0b\x0c\r"
LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
# Change below which messages have settled, double sweeps after which they are damped and after which a
# text that still swings is left as it is, and the marginal probability a span needs.
SETTLED, FREE_SWEEPS, SWEEPS, CERTAIN = 1e-4, 10, 200, 0.9
# --- fixed values: country codes of two digits; those that begin with 1 or 7 have one, all others three ---
TWO_DIGIT_CODES = frozenset(
    ("20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53",
     "54", "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98")
)
# Digits a number needs to be known again, those at which it surely is, and groups of digits that may be one number.
KNOWN_DIGITS, SURE_DIGITS, GROUPS = 7, 10, 5
# The least chance that a repetition of a token is of a kind, whatever the counts say of its looks: patterns miss some.
MISSED = 0.01
# Code of a label: 0 none, then KINDS.
N_LABELS = 1 + len(KINDS)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = 2 * n - 9 if n > 4 else 2 * n
        total += n
    return total % 10 == 0


def only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost addresses, in linear time: the run of local characters before an at sign, then a domain."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            free = domain.end()
            found.append((start, free))
        else:
            free = max(free, at + 1)
        at = text.find("@", max(at + 1, free))
    return found


def addresses(text: str) -> list[tuple[int, int]]:
    """IP addresses: four parts at a time from the left of each dotted run of numbers."""
    found = []
    for run in DOTTED.finditer(text):
        parts = run.group().split(".")
        if len(parts) < 4:
            continue
        at = run.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                found.append((at, end))
            at = end + 1
    return found


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of the four patterns, leftmost and non-overlapping per kind; matches that fail their check are dropped."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        found["email"] = emails(text)
    found["ip"] = addresses(text)
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := only_digits(m.group())) <= 19 and luhn(d):
            found["card"].append(m.span())
    if "+" in text:
        found["phone"] = [m.span() for m in PHONE.finditer(text) if 8 <= len(only_digits(m.group())) <= 15]
    return found


def _bucket(n: int) -> int:
    return next((i for i, top in enumerate((0, 1, 2, 3, 6, 8, 12, 15, 19)) if n <= top), 9)


def marked_tokens(text: str) -> Iterator[tuple[int, int, int, int]]:
    """Start and end of every word with a digit or an at sign, and of its core without outer punctuation; linear."""
    end = 0
    for m in MARK.finditer(text):
        if m.start() < end:
            continue
        start = max(end, 1 + max(text.rfind(c, end, m.start()) for c in BLANKS))
        blank = BLANK.search(text, m.end())
        end = blank.start() if blank else len(text)
        a, b = start, end
        while a < b and text[a] not in LETTERS and text[a] not in "+(":
            a += 1
        while a < b and text[b - 1] not in LETTERS and text[b - 1] != ")":
            b -= 1
        yield start, end, a, b


def number_keys(kind: int, digits: str) -> set[str]:
    """Under which digits a covered number may stand again: whole, and a phone number less its country code; no leading zeros."""
    whole = digits.lstrip("0")
    code = 1 if whole[:1] in ("1", "7") else 2 if whole[:2] in TWO_DIGIT_CODES else 3
    keys = {whole, whole[code:].lstrip("0")} if KINDS[kind] == "phone" else {whole}
    return {k for k in keys if len(k) >= KNOWN_DIGITS}


def joined_numbers(text: str, tokens: list[tuple[int, int, int, int]], known: set[str], free: Callable[[int, int], bool]) -> list[tuple[int, int, int, int]]:
    """The tokens, groups of digits that together are a known number made one token; `free` tells what no pattern covers."""
    out, i = [], 0
    while i < len(tokens):
        digits, end, last = "", tokens[i][0] - 1, i
        for j in range(i, min(i + GROUPS, len(tokens))):
            start, stop, a, b = tokens[j]
            if start != end + 1 or any(c.isalpha() or c == "@" for c in text[a:b]) or not free(a, b):
                break
            digits, end = digits + only_digits(text[a:b]), stop
            if j > i and digits.lstrip("0") in known:
                last = j
        out.append((tokens[i][0], tokens[last][1], tokens[i][2], tokens[last][3]))
        i = last + 1
    return out


@dataclass
class Graph:
    """Tokens of some texts that hold a digit or an at sign, and the edges of the field.

    Other tokens have no features and are no one's personal data, so they cut the
    chain. `chain` joins neighbouring tokens; `skip` joins each token to the next in its text that is the same:
    the same digits but for leading zeros (seven or more, no letters), a phone number with or without its country
    code, or the same text (case ignored) if it has letters beside such digits, an at sign or three dots.
    Digit groups that together are a number found in the text are one token. Of such repetitions, each that no
    pattern covers is also joined to a covered one: the last before it, else the first. So what is found in a text is one
    edge away from all its repetitions, however many there are. `weight` of a skip edge falls below 1 for
    numbers under ten digits.
    """

    row: list[int]
    span: list[tuple[int, int]]
    label: np.ndarray
    features: list[str]
    chain: np.ndarray
    skip: np.ndarray
    weight: np.ndarray


def graph_of(texts: list[str], bases: list[dict[str, list[tuple[int, int]]]]) -> Graph:
    row, span, label, features, chain, skip = [], [], [], [], [], {}
    for i, (text, base) in enumerate(zip(texts, bases)):
        known = sorted((a, b, k + 1) for k, kind in enumerate(KINDS) for a, b in base[kind])
        keys_of = {
            (a, b, k): number_keys(k - 1, only_digits(text[a:b])) for a, b, k in known if KINDS[k - 1] in ("card", "phone")
        }
        tokens = [t for t in marked_tokens(text) if t[2] < t[3]]
        if keys_of:
            starts, reach = [k[0] for k in known], np.maximum.accumulate([k[1] for k in known]).tolist()

            def free(a: int, b: int) -> bool:
                before = bisect_left(starts, b) - 1
                return before < 0 or reach[before] <= a

            tokens = joined_numbers(text, tokens, set().union(*keys_of.values()), free)
        # A token carries the label of the span that covers its start or that starts in it, the first kind if several.
        at, before_end, seen, covered, waiting, told = 0, -2, {}, {}, {}, set()
        for start, end, a, b in tokens:
            word = text[a:b]
            while at < len(known) and known[at][1] <= a:
                at += 1
            near, mark, own = at, 0, None
            while not mark and near < len(known) and known[near][0] < b:
                if known[near][1] > a:
                    mark, own = known[near][2], known[near]
                near += 1
            node = len(row)
            digits = only_digits(word)
            letters = any(c.isalpha() for c in word)
            joined = start == before_end + 1
            features.append(
                f"{_bucket(len(digits))}.{min(word.count('.'), 4)}.{min(word.count('-'), 4)}.{'@' in word:d}{word[0] == '+':d}"
                f"{word[0] == '(':d}{letters:d}{joined:d}{13 <= len(digits) <= 19 and luhn(digits):d}"
            )
            if joined:
                chain.append((node - 1, node))
            if own in keys_of:
                # The first token of a number stands for all of it.
                keys = set() if own in told else keys_of[own]
                told.add(own)
            elif "@" in word or word.count(".") >= 3 or (letters and len(digits) >= KNOWN_DIGITS):
                keys = {word.lower()}
            else:
                plain = digits.lstrip("0")
                keys = {plain} if len(plain) >= KNOWN_DIGITS and not letters else set()
            for key in sorted(keys):
                weight = min(1.0, len(key) / SURE_DIGITS) if key.isdigit() else 1.0
                edges = [seen[key]] if key in seen else []
                seen[key] = node
                if mark:
                    edges += waiting.pop(key, [])
                    covered[key] = node
                elif key in covered:
                    edges.append(covered[key])
                else:
                    waiting.setdefault(key, []).append(node)
                for early in edges:
                    skip[early, node] = max(weight, skip.get((early, node), 0.0))
            row.append(i)
            span.append((a, b))
            label.append(mark)
            before_end = end
    pairs = lambda edges: np.array(sorted(set(edges)), np.int64).reshape(-1, 2)
    skips = pairs(skip)
    weight = np.array([skip[x, y] for x, y in skips.tolist()])
    return Graph(row, span, np.array(label, np.int64), features, pairs(chain), skips, weight)


@dataclass
class Field:
    """Log potentials: of a label given a token's features, and of label pairs along both kinds of edges."""

    unary: dict[str, np.ndarray]
    unknown: np.ndarray
    chain: np.ndarray
    skip: np.ndarray

    def marginals(self, graph: Graph) -> np.ndarray:
        """Label probabilities of all tokens by loopy belief propagation; labels of base spans are observed.

        An observed token says the same to its neighbours whatever they answer: that goes into their scores,
        and its edges are gone. Along the others messages sweep forward and backward, each token after
        all before it, until none of its text changes any more; so one sweep carries a message to the end of any chain.
        All texts of a slice sweep at once, and a sweep is linear in the edges.
        """
        n = len(graph.row)
        score = np.array([self.unary.get(f, self.unknown) for f in graph.features]).reshape(n, N_LABELS)
        known = graph.label > 0
        # Counts take what no pattern covers for none; of a repetition of something found that is just what is not known.
        for here, there in (graph.skip.T, graph.skip[:, ::-1].T):
            again = known[here] & ~known[there]
            here, there = graph.label[here[again]], there[again]
            score[there, here] = np.maximum(score[there, here], np.log(MISSED))
        strength = [np.ones(len(graph.chain)), graph.weight]
        for edges, table, weight in ((graph.chain, self.chain, strength[0]), (graph.skip, self.skip, strength[1])):
            for here, there, pair in ((edges[:, 0], edges[:, 1], table), (edges[:, 1], edges[:, 0], table.T)):
                told = known[here] & ~known[there]
                np.add.at(score, there[told], pair[graph.label[here[told]]] * weight[told, None])
        score[known] = -30.0
        score[known, graph.label[known]] = 0.0
        open_ = [~known[edges].any(axis=1) for edges in (graph.chain, graph.skip)]
        free = [edges[which] for edges, which in zip((graph.chain, graph.skip), open_)]
        weight = np.concatenate([w[which] for w, which in zip(strength, open_)] * 2)[:, None, None]
        edges = np.concatenate(free)
        if not len(edges):
            return _softmax(score)
        m = len(edges)
        # Messages 0 to m - 1 go forward along the edges, the others back; `kind` tells their tables apart.
        source, target = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
        tables = np.stack([self.chain, self.skip, self.chain.T, self.skip.T])
        kind = np.repeat(np.arange(4), [len(free[0]), len(free[1])] * 2)
        back = np.concatenate([np.arange(m) + m, np.arange(m)])
        row = np.array(graph.row)[source]
        # How many edges lead up to a token at most, and how many lead on from it.
        before, after = [0] * n, [0] * n
        for a, b in edges[np.argsort(edges[:, 1], kind="stable")].tolist():
            before[b] = max(before[b], before[a] + 1)
        for a, b in edges[np.argsort(-edges[:, 0], kind="stable")].tolist():
            after[a] = max(after[a], after[b] + 1)
        turn = np.concatenate([np.array(before)[edges[:, 0]], np.array(after)[edges[:, 1]] + max(before)])
        order = np.argsort(turn, kind="stable")
        message = np.zeros((2 * m, N_LABELS))
        for sweep in range(SWEEPS):
            moved = np.zeros(graph.row[-1] + 1)
            for live in np.split(order, np.flatnonzero(np.diff(turn[order])) + 1):
                outgoing = (score[source[live]] - message[back[live]])[:, :, None] + tables[kind[live]] * weight[live]
                top = outgoing.max(axis=1, keepdims=True)
                new = (top + np.log(np.exp(outgoing - top).sum(axis=1, keepdims=True)))[:, 0]
                new -= new.max(axis=1, keepdims=True)
                # Damped at length, so that loops settle.
                change = (new - message[live]) * (1.0 if sweep < FREE_SWEEPS else 0.5)
                message[live] += change
                np.add.at(score, target[live], change)
                np.maximum.at(moved, row[live], np.abs(change).max(axis=1))
            order = order[moved[row[order]] >= SETTLED]
            if not len(order):
                break
        return _softmax(score)


def _softmax(score: np.ndarray) -> np.ndarray:
    p = np.exp(score - score.max(axis=1, keepdims=True)) if len(score) else score
    return p / p.sum(axis=1, keepdims=True) if len(score) else p


def fit_field(counts: dict[tuple[str, str, int, int], int]) -> Field:
    """Piecewise training from counts over the whole corpus.

    Keys are ("token", features, label, 0), ("chain", "", label, label) and ("skip",
    "", label, label). A token's potential is the smoothed log-probability of its
    label given its features; an edge's is the smoothed log-ratio of the pair to
    independence. The labels are those of the base patterns. They are right where a
    pattern matches and unknown elsewhere, so a skip edge of which one end only is
    covered is no example: it is the case the field is to decide.
    """
    label = np.ones(N_LABELS)
    by_feature: dict[str, np.ndarray] = {}
    pairs = {"chain": np.full((N_LABELS, N_LABELS), 0.1), "skip": np.full((N_LABELS, N_LABELS), 0.1)}
    for (part, name, x, y), n in counts.items():
        if part == "token":
            by_feature.setdefault(name, np.zeros(N_LABELS))[x] += n
            label[x] += n
        elif part == "chain" or (x > 0) == (y > 0):
            pairs[part][x, y] += n
    prior = label / label.sum()
    ratio = {}
    for part, seen in pairs.items():
        # The two ends of an edge are alike but for their order: a skip edge has no direction.
        seen = seen + seen.T if part == "skip" else seen
        joint = (seen + 2 * np.outer(prior, prior)) / (seen.sum() + 2)
        ratio[part] = np.log(joint / np.outer(joint.sum(1), joint.sum(0)))
    unary = {f: np.log((n + 2 * prior) / (n.sum() + 2)) for f, n in by_feature.items()}
    return Field(unary, np.log(prior), ratio["chain"], ratio["skip"])


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str], list[dict], Graph]]:
    for batch in sliced(batches, "text"):
        texts = pc.fill_null(batch.column("text"), "").to_pylist()
        bases = [base_spans(t) for t in texts]
        yield batch, texts, bases, graph_of(texts, bases)


def train_field(docs: DataFrame) -> Field:
    """Counts features and label pairs of all documents; a few thousand distinct rows at most reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for _, _, _, graph in _slices(batches):
            label = graph.label.tolist()
            counts.update(("token", f, x, 0) for f, x in zip(graph.features, label))
            counts.update(("chain", "", label[a], label[b]) for a, b in graph.chain.tolist())
            counts.update(("skip", "", label[a], label[b]) for a, b in graph.skip.tolist())
        if counts:
            rows = sorted(counts.items())
            part, name, x, y = zip(*(k for k, _ in rows))
            yield pa.RecordBatch.from_arrays(
                [pa.array(part), pa.array(name), pa.array(x, pa.int32()), pa.array(y, pa.int32()), pa.array([n for _, n in rows], pa.int64())],
                ["part", "name", "x", "y", "n"],
            )

    found = docs.select("text").mapInArrow(run, "part string, name string, x int, y int, n bigint")
    total = found.groupBy("part", "name", "x", "y").agg(F.sum("n").alias("n")).collect()
    return fit_field({(r["part"], r["name"], r["x"], r["y"]): r["n"] for r in total})


def all_spans(texts: list[str], bases: list[dict], graph: Graph, field: Field) -> list[list[tuple[int, int, int, bool]]]:
    """Per text its spans (kind number, start, end, from a pattern) by kind, then start."""
    spans = [[(k, a, b, True) for k, kind in enumerate(KINDS) for a, b in base[kind]] for base in bases]
    if graph.row:
        chance = field.marginals(graph)
        best = chance.argmax(axis=1)
        for node in np.flatnonzero((graph.label == 0) & (best > 0) & (chance.max(axis=1) >= CERTAIN)).tolist():
            a, b = graph.span[node]
            spans[graph.row[node]].append((int(best[node]) - 1, a, b, False))
    return [sorted(s) for s in spans]


def listed(spans: list[tuple[int, int, int, bool]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b, _ in spans)


def redacted(text: str, spans: list[tuple[int, int, int, bool]]) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans become one, named after the first."""
    parts, at = [], 0
    for a, b, k in sorted((a, b, k) for k, a, b, _ in spans):
        if a >= at:
            parts += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join([*parts, text[at:]])


SPAN = "struct<kind:string,start:bigint,end:bigint,base:boolean>"


def find_pii(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """Adds `pii` (array of kind, start, end, base; code points, end exclusive) and `redacted` to every document.

    The patterns find e-mail and IP addresses, card and phone numbers in whole texts.
    A skip-chain conditional random field then labels the tokens with a digit or an
    at sign that no pattern covers: neighbours share potentials, and so do distant
    tokens that are the same address or the same whole number, a phone number with or without its country code
    and trunk zero, in one token or in groups. Numbers that only end alike share nothing. Loopy message passing
    carries the label of a found number to its bare repetitions at any distance, and a token whose
    marginal reaches 0.9 becomes a span too (`base` false).

    Scale: two narrow passes, one to count features and label pairs over the whole
    corpus, one to label; no shuffle of text. All patterns and edges are linear in the text's length.

    A null text has no spans and stays null when redacted; empty texts have none;
    equal rows get equal results; an empty table gives no rows; other columns stay
    (those named like a result are replaced).
    """
    field = train_field(docs) if field is None else field
    base = docs.drop("pii", "redacted")
    span_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts, bases, graph in _slices(batches):
            spans = all_spans(texts, bases, graph, field)
            rows = [[{"kind": KINDS[k], "start": a, "end": b, "base": known} for k, a, b, known in s] for s in spans]
            clean = pa.array([redacted(t, s) for t, s in zip(texts, spans)], pa.string())
            clean = pc.if_else(pc.is_valid(batch.column("text")), clean, pa.scalar(None, pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, span_type), clean], [*batch.schema.names, "pii", "redacted"])

    return base.mapInArrow(run, with_columns(base, f"pii array<{SPAN}>, redacted string"))


def redact(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """The documents with their personal data replaced in `text`, and `n_chars`, where present, set anew.

    Columns and their order stay as they are; null texts stay null.
    """
    field = train_field(docs) if field is None else field

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts, bases, graph in _slices(batches):
            spans = all_spans(texts, bases, graph, field)
            clean = pa.array([redacted(t, s) for t, s in zip(texts, spans)], pa.string())
            clean = pc.if_else(pc.is_valid(batch.column("text")), clean, pa.scalar(None, pa.string()))
            at = batch.schema.get_field_index("text")
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], clean, *batch.columns[at + 1 :]], batch.schema.names)

    clean = docs.mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return clean


def query(spark: SparkSession, folder: str) -> DataFrame:
    found = find_pii(table(spark, folder, "documents").select("doc_id", "text"))
    own = F.filter("pii", lambda s: s["base"])
    text_of = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    kinds = F.transform(own, lambda s: s["kind"])
    # An array without one of its values is that much shorter.
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(text_of(own), 256).alias("base_sha256"), text_of(F.col("pii")).alias("spans"))
