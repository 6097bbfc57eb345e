"""Operator 7: secrets in texts.

Base: three fixed kinds, leftmost and non-overlapping per kind: assign (a value of 6 or more
characters given to a password-like name), access (an access key id of 20 or more characters) and
hex (a lower-case hexadecimal run of 24 or more).

Method (kind novel): dictionary-primed zstandard. In the WINDOW characters after a sensitive word,
every candidate of NOVEL_LENGTH or more characters is compressed after a dictionary of common
identifiers and the code around it: once the surroundings alone and once with the candidate. The
bytes that it adds, as a whole or a window of it, against what its alphabet would need at least, say how new it is; one that the
dictionaries don't help to compress is reported, and with it every other place of the same string,
in a sensitive context or not. Candidates and base spans are blanked out of the surroundings first,
so that a secret's copies don't hide each other. A copy outside any sensitive context isn't a
candidate and stays: a string that stands near such a copy is taken as known. A candidate that
overlaps a base span isn't reported again.

Null or empty text: no spans. Ties, that is spans with one start: in the order of KINDS. Repeated
rows: each is scanned. Very long texts and candidates are scanned whole. Extra columns are ignored by scan() except those named in keep.
"""

from __future__ import annotations

import bisect
import collections
import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

KINDS = ("assign", "access", "hex", "novel")

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
#: Runs too short would be dropped after matching; as a run is matched whole, asking for the length at once is the same.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Words that put what follows into a sensitive context.
SENSITIVE = ("access", "api", "auth", "bearer", "cert", "cookie", "cred", "jwt", "key", "login", "passphrase", "passwd", "password", "private", "pwd", "salt", "secret", "session", "signature", "token")
CONTEXT = re.compile(r"(?:" + "|".join(SENSITIVE) + r""")[A-Za-z_]{0,16}["'`]?\x20{0,4}(?:[:=]|=>|\x20is\b|\x20)""", re.ASCII | re.IGNORECASE)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_~=.-]{16,}")
WINDOW = 48
NOVEL_LENGTH = 16
#: A candidate is judged as a whole and in windows of so many characters, STEP apart, so that a key in a long run of
#: something else is found; it is reported whole if any of them is new.
PART = 32
STEP = 8
#: Further candidates of one run, those that begin behind its first sensitive place, are judged as a whole up to this
#: length; longer ones by the run's windows only.
WHOLE = 512
#: Share of the bits of a random string that a candidate has to add.
NOVELTY = 0.8

#: Identifiers and phrases that code and configuration are full of.
IDENTIFIERS = """abstract accept access account action active address admin after alert alias align allow alpha amount
android angle append application apply argument array arrow article assert assign async attach attribute author auto
available average await background backup balance balancer band bar base batch before begin behavior binary block
board body boolean border bottom branch break browser buffer build builder bundle button byte cache calendar call
callback camera cancel case catch category center chain change channel character check child class clean clear click
client clone close cloud cluster code collection color column command comment commit common compare compile complete
component compute condition config configuration confirm connect connection console constant constructor container
content context continue control controller convert cookie copy core count country create current custom data database
date debug decode default define delete deploy description design detail device dialog dictionary directory disable
display distance document domain double download draw driver dynamic edit editor element email empty enable encode
endpoint engine enter entity entry enum environment error event example exception execute exist exit expand export
expression extend external factory failed feature fetch field file filter final find finish first flag float folder
follow font footer form format forward frame framework function gateway general generate global graph group handle
handler hash header height hidden history home host html http https icon identifier image implement import include
index info init input insert install instance integer interface internal invalid item iterator javascript job join
json kernel keyboard label language last layer layout left length level library license limit line link list listen
load loader local location lock logger login logout loop machine main manager mapping margin match matrix maximum
media member memory menu merge message metadata method minimum mobile mode model module monitor month mount mouse
multiple name native navigation network next node normal notification null number object offset online open operation
operator option order origin output owner package padding page panel parallel parameter parent parse parser password
path pattern payload performance permission phone picture pixel platform play plugin pointer policy pool popup port
position post prefix press preview price primary print priority private process processor product profile program
project promise property protected protocol provider proxy public publish query queue random range read reader
receive record redirect refresh region register release remote remove render replace report repository request
require reset resource response restore result resume return right role root route router rows sample save scale
schedule schema scope screen script scroll search second secret section security select send sender sequence server
service session setting setup shape share shell show signal simple single size skip socket sort source space special
split stack stage standard start state static status step stop storage store stream string structure style submit
success suffix support switch symbol sync system table target task team template temp test text theme thread time
timeout title toggle token tool toolbar total trace track transaction transform transition trigger true type undefined
union unique unit update upload user username utility valid validate value variable vector version video view virtual
visible volume wait warning watch webhook widget width window with word work worker workspace wrapper write writer
access_token api_key auth_token bearer client_id client_secret credentials private_key public_key refresh_token
secret_key session_id abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 https://www. .com/ .org/ .html
"""


class Novelty:
    """Bytes that a candidate adds to its surroundings under the identifier dictionary."""

    def __init__(self, identifiers: str = IDENTIFIERS):
        import zstandard

        words = identifiers.encode()
        # raw content; what lies last is cheapest to refer to
        primed = zstandard.ZstdCompressionDict(words.upper() + words.title() + words, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.pack = zstandard.ZstdCompressor(level=9, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False)

    def share(self, before: str, candidate: str, after: str) -> float:
        """Bits added, as a share of the bits of a random string over the candidate's kinds of characters."""
        around = (before + after).encode() + b"\n"
        added = len(self.pack.compress(around + candidate.encode())) - len(self.pack.compress(around))
        return 8 * added / (len(candidate) * math.log2(alphabet(candidate)))

    def window(self, before: str, run: str, k: int, after: str) -> bool:
        """Whether the PART characters of a run from k on add as much as random ones would."""
        part = run[k : k + PART]
        if not mixed(part):
            return False
        return self.share((before + run[max(0, k - 256) : k])[-256:], part, (run[k + PART : k + PART + 128] + after)[:128]) >= NOVELTY


class Run:
    """A candidate run from its first sensitive place on. Its windows are judged once, whatever the places in it."""

    def __init__(self, novelty: Novelty, before: str, run: str, after: str):
        self.novelty, self.before, self.run, self.after = novelty, before, run, after
        self.last: int | None = None

    def last_new(self) -> int:
        """Where the last window starts that is new; -1 if none is."""
        if self.last is None:
            starts = range(0, len(self.run) - PART, STEP)
            self.last = next((k for k in reversed(starts) if self.novelty.window(self.before, self.run, k, self.after)), -1)
        return self.last

    def new(self, k: int, before: str) -> bool:
        """Whether the run from k on is new: as a whole, if it is the first place or no longer than WHOLE, or in any of its windows."""
        if (not k or len(self.run) - k <= WHOLE) and self.novelty.share(before, self.run[k:], self.after) >= NOVELTY:
            return True
        return self.last_new() >= k if len(self.run) > k + PART else False


def alphabet(text: str) -> int:
    """Size of the smallest usual alphabet with all its characters."""
    if re.fullmatch(r"[0-9]+", text):
        return 10
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", text):
        return 16
    size = 26 * (bool(re.search("[a-z]", text)) + bool(re.search("[A-Z]", text)))
    return max(2, size + 10 * bool(re.search("[0-9]", text)) + 4 * bool(re.search("[^A-Za-z0-9]", text)))


def mixed(text: str) -> bool:
    """Letters and digits in turn, as keys have and words, paths and numbers have not."""
    return bool(re.search("[0-9]", text)) and bool(re.search("[A-Za-z]", text)) and len(re.findall(r"(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])|(?<=[a-z])(?=[A-Z])", text)) >= 3


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of every base match."""
    spans = []
    lower = text.lower() if ("=" in text or ":" in text) else ""
    if any(name in lower for name in NAMES):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    return spans + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]


def novel_spans(text: str, base: list[tuple[int, int, int]], novelty: Novelty) -> list[tuple[int, int, int]]:
    """Incompressible candidates in a sensitive context that overlap no base span, and all other places of the same strings."""
    contexts = [m.end() for m in CONTEXT.finditer(text)]
    if not contexts:
        return []
    runs = [m.span() for m in CANDIDATE.finditer(text)]
    begins = [b for b, _ in runs]
    covers = merged([(b, e) for b, _, e in base])
    edges = [b for b, _ in covers]
    met: dict[int, dict[int, int]] = {}  # by run: starts of its candidates, and their end
    ready: dict[int, tuple[int, int, int, int]] = {}
    for at in contexts:
        r = bisect.bisect_right(begins, at) - 1
        r = r if r >= 0 and at <= runs[r][1] - NOVEL_LENGTH else r + 1
        while r < len(runs) and runs[r][0] <= at + WINDOW:
            begin, behind = runs[r]
            start = max(begin, at)
            if start not in met.get(r, ()):
                if r not in ready:
                    ready[r] = traits(text, begin, behind)
                trimmed, digit, letter, turn = ready[r]
                end = max(trimmed, start + NOVEL_LENGTH)
                k = bisect.bisect_left(edges, end) - 1
                if min(digit, letter, turn) >= start and (k < 0 or covers[k][1] <= start):
                    met.setdefault(r, {})[start] = end
            r += 1
    if not met:
        return []
    # candidates and base spans tell nothing about how new another candidate is, least of all its own copies
    plain = blanked(text, sorted([span for starts in met.values() for span in starts.items()] + [(b, e) for b, _, e in base]))
    found, strings = {}, {}
    for r, starts in met.items():
        first, behind = min(starts), runs[r][1]
        after = plain[behind : behind + 128]
        run = Run(novelty, plain[max(0, first - 256) : first], text[first : starts[first]], after)
        for start in sorted(starts):
            if starts[start] != starts[first]:  # so near the run's end that nothing is trimmed
                new = Run(novelty, "", text[start : starts[start]], after).new(0, plain[max(0, start - 256) : start])
            else:
                new = run.new(start - first, plain[max(0, start - 256) : start])
            if new:
                found[start] = starts[start]
                # of the strings that end with a run, the longest and the short ones are looked for elsewhere
                if starts[start] - start <= WHOLE or not any(first <= s < start for s in strings):
                    strings[start] = starts[start]
    return [(start, 3, end) for start, end in places(text, found, strings, base).items()]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that touch as one."""
    out: list[tuple[int, int]] = []
    for b, e in sorted(spans):
        if out and b <= out[-1][1]:
            out[-1] = out[-1][0], max(e, out[-1][1])
        else:
            out.append((b, e))
    return out


TURN = re.compile(r"(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])|(?<=[a-z])(?=[A-Z])")


def traits(text: str, begin: int, end: int) -> tuple[int, int, int, int]:
    """Of a run: its end without marks, and the last starts with a digit, a letter and three turns behind them (-1: none)."""
    trimmed = end
    while trimmed > begin and text[trimmed - 1] in ".=-":
        trimmed -= 1
    digit = letter = -1
    for m in re.finditer("[0-9]+", text[begin:trimmed]):
        digit = begin + m.end() - 1
    for m in re.finditer("[A-Za-z]+", text[begin:trimmed]):
        letter = begin + m.end() - 1
    turns = collections.deque((m.start() for m in TURN.finditer(text[begin:trimmed])), maxlen=3)
    return trimmed, digit, letter, begin + turns[0] - 1 if len(turns) == 3 else -1


def blanked(text: str, spans: list[tuple[int, int]]) -> str:
    """text with the sorted spans made blanks."""
    out, at = [], 0
    for start, end in spans:
        if end > at:
            out += [text[at:start], " " * (end - max(start, at))]
            at = end
    return "".join([*out, text[at:]])


def places(text: str, found: dict[int, int], looked_for: dict[int, int], base: list[tuple[int, int, int]]) -> dict[int, int]:
    """found (start and end) and every other place of the strings looked for that isn't wholly inside another span."""
    if not found:
        return found
    by_head: dict[str, set[str]] = {}
    for start, end in looked_for.items():
        by_head.setdefault(text[start : start + NOVEL_LENGTH], set()).add(text[start:end])
    longest = {head: sorted(strings, key=len, reverse=True) for head, strings in by_head.items()}
    covered = sorted([(b, e) for b, _, e in base] + list(found.items()))
    out, k, reach = dict(found), 0, 0
    for run in CANDIDATE.finditer(text):
        at = run.start()
        while at <= run.end() - NOVEL_LENGTH:
            while k < len(covered) and covered[k][0] <= at:
                reach = max(reach, covered[k][1])
                k += 1
            string = next((s for s in longest.get(text[at : at + NOVEL_LENGTH], ()) if text.startswith(s, at)), None)
            if string and at + len(string) > reach:
                out[at] = at + len(string)
            at += len(string) if string else 1
    return out


def named(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{start}:{end}" for start, k, end in sorted(spans))


SCHEMA = (
    T.StructField("n_assign", T.LongType()),
    T.StructField("n_access", T.LongType()),
    T.StructField("n_hex", T.LongType()),
    T.StructField("n_novel", T.LongType()),
    T.StructField("base_spans", T.StringType()),
    T.StructField("spans", T.StringType()),
)


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """text with each run of spans replaced by a mark; a name before an assigned value goes with it."""
    out, at = [], 0
    for start, _, end in sorted(spans):
        if start >= at:
            out += [text[at:start], "[secret]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def scan(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns keep and, per row, counts, base_spans and spans (kind:start:end, code points)."""
    kept = [f for f in df.schema if f.name in keep]
    names = [f.name for f in (*kept, *SCHEMA)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = common.kept("novelty", Novelty)
        for whole in batches:
            _, at = common.buffers(whole.column(text))
            for lo, hi in common.passes(at, 8 << 20):
                batch = whole.slice(lo, hi - lo)
                columns: list[list] = [[] for _ in SCHEMA]
                for value in batch.column(text).to_pylist():
                    value = value or ""
                    base = base_spans(value)
                    spans = base + novel_spans(value, base, novelty)
                    row = [sum(s[1] == k for s in spans) for k in range(4)] + [named(base), named(spans)]
                    for column, x in zip(columns, row, strict=True):
                        column.append(x)
                arrays = [batch.column(f.name) for f in kept]
                arrays += [pa.array(c, pa.int64() if isinstance(f.dataType, T.LongType) else pa.string()) for c, f in zip(columns, SCHEMA, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return df.select(*dict.fromkeys((*keep, text))).mapInArrow(run, T.StructType([*kept, *SCHEMA]))


def redacted(df: DataFrame, text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """All rows and columns, with every span in text replaced by a mark and n_chars counted anew. Null text stays null."""
    names = df.columns
    at_text = names.index(text)
    at_chars = names.index(n_chars) if n_chars in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = common.kept("novelty", Novelty)
        for whole in batches:
            _, at = common.buffers(whole.column(text))
            for lo, hi in common.passes(at, 8 << 20):
                batch = whole.slice(lo, hi - lo)
                columns = list(batch.columns)
                made = []
                for value in batch.column(text).to_pylist():
                    base = base_spans(value or "")
                    made.append(value if value is None else redact(value, base + novel_spans(value, base, novelty)))
                columns[at_text] = pa.array(made, pa.string())
                if at_chars is not None:
                    kind = columns[at_chars].type
                    kept = columns[at_chars].to_pylist()
                    columns[at_chars] = pa.array([k if m is None else len(m) for m, k in zip(made, kept, strict=True)], kind)
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return df.mapInArrow(run, df.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_novel")


def sha256_of_spans(text: str) -> str:
    """What base_sha256 is for one text."""
    return hashlib.sha256(named(base_spans(text)).encode()).hexdigest()
