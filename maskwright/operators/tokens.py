"""From a model's tokens to spans: placing pieces in the text, chunks within a token budget, repairs of split spans.

A tokenizer is a function from a text to its pieces; it runs inside tasks, a batch of texts at a time.
Pieces mark a word's start with ``▁`` or a word's continuation with ``##``. Places are code points.
Placing searches strings and so runs in Arrow batches; what follows from places (chunks, predictions,
repairs) is SQL over arrays.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.functions.text import islands, let, ner_label, quoted
from maskwright.schema import SPAN, TYPES

Tokenizer = Callable[[str], list[str]]

# Control tokens, the marks of pieces, the reach of a new start and the least share of placed pieces.
SPECIAL = frozenset(("<s>", "</s>", "<pad>", "<unk>", "<mask>", "[CLS]", "[SEP]", "[PAD]", "[UNK]", "[MASK]"))
STARTS, ENDS = ("<s>", "[CLS]"), ("</s>", "[SEP]")
START_MARK, INNER_MARK = "▁", "##"
REACH = 48
LEAST_PLACED = 0.8
MAX_TOKENS, OVERLAP_TOKENS, OVERLAP_CHARS = 480, 64, 256

# Labels of models by type; a label that is a type itself stands for it where a model has it.
MODEL_LABELS = {
    "ai4privacy": {
        "PERSON": ("PER", "PERSON", "NAME", "FULL_NAME", "FIRSTNAME", "FIRST_NAME", "GIVEN_NAME", "LASTNAME", "LAST_NAME", "FAMILY_NAME", "MIDDLENAME", "MIDDLE_NAME"),
        "ORGANIZATION": ("ORG", "ORGANIZATION", "ORGANISATION", "COMPANY", "COMPANY_NAME", "COMPANYNAME", "BUSINESS"),
        "LOCATION": ("LOC", "LOCATION", "GPE", "CITY", "COUNTRY", "STATE", "COUNTY", "REGION"),
        "ADDRESS": ("ADDRESS", "STREET", "STREET_ADDRESS", "STREETADDRESS", "POSTAL_ADDRESS", "POSTCODE", "POSTAL_CODE", "ZIP", "ZIPCODE", "ZIP_CODE"),
        "URL": ("URL", "URI", "WEBSITE", "WEB_URL"),
        "USERNAME": ("USERNAME", "USER_NAME", "HANDLE", "LOGIN"),
        "PASSWORD": ("PASSWORD", "PASSWD", "PASSCODE", "PIN"),
        "BANK_ACCOUNT": ("BANK_ACCOUNT", "BANKACCOUNT", "ACCOUNT_NUMBER", "ACCOUNTNUMBER", "BANK_ACCOUNT_NUMBER"),
        "EMAIL": ("EMAIL", "EMAIL_ADDRESS", "MAIL"),
        "PHONE": ("PHONE", "PHONE_NUMBER", "PHONENUMBER", "TELEPHONE", "MOBILE"),
        "CREDIT_CARD": ("CREDIT_CARD", "CREDITCARD", "CREDIT_CARD_NUMBER", "CREDITCARDNUMBER"),
        "SSN": ("SSN", "SOCIAL_SECURITY_NUMBER", "SOCIALSECURITYNUMBER"),
        "IBAN": ("IBAN", "IBAN_CODE"),
        "IP_ADDRESS": ("IP", "IP_ADDRESS", "IPV4", "IPV6"),
        "DATE": ("DATE", "DOB", "DATE_OF_BIRTH", "BIRTHDATE"),
        "MISC": ("MISC", "PASSPORT", "PASSPORT_NUMBER", "DRIVER_LICENSE", "DRIVERS_LICENSE", "NATIONAL_ID", "ID_CARD"),
    },
    "bardsai": {
        "PERSON": ("PERSON_ALIAS", "PERSON_NAME"),
        "ORGANIZATION": ("ORGANIZATION_IDENTIFIER", "ORGANIZATION_NAME"),
        "LOCATION": ("GEO_LOCATION", "LOCATION"),
        "ADDRESS": ("POSTAL_ADDRESS",),
        "URL": ("IDENTIFYING_LINK",),
        "USERNAME": ("ACCOUNT_IDENTIFIER", "CONTACT_HANDLE"),
        "PASSWORD": ("AUTH_SECRET",),
        "BANK_ACCOUNT": ("BANK_ACCOUNT_IDENTIFIER",),
        "EMAIL": ("EMAIL_ADDRESS",),
        "PHONE": ("PHONE_NUMBER",),
        "CREDIT_CARD": ("PAYMENT_CARD", "PAYMENT_CARD_SECURITY"),
        "IP_ADDRESS": ("IP_ADDRESS",),
        "DATE": ("DATE_OF_BIRTH",),
        "MISC": ("BIOMETRIC_DATA", "CRIMINAL_OFFENCE_DATA", "DEVICE_IDENTIFIER", "DOCUMENT_IDENTIFIER", "DOCUMENT_REFERENCE", "ETHNIC_ORIGIN", "FINANCIAL_AMOUNT", "HEALTH_DATA", "PERSON_ATTRIBUTE", "PERSON_IDENTIFIER", "PERSON_ROLE_OR_TITLE", "POLITICAL_OPINION", "PROPER_NAME", "RELIGION_OR_BELIEF", "SEXUAL_ORIENTATION", "TRADE_UNION_MEMBERSHIP", "VEHICLE_IDENTIFIER"),
    },
    "hikmaai": {
        "PERSON": ("GIVENNAME", "SURNAME"),
        "LOCATION": ("CITY",),
        "ADDRESS": ("STREET", "BUILDINGNUM", "ZIPCODE"),
        "USERNAME": ("USERNAME",),
        "PASSWORD": ("PASSWORD",),
        "BANK_ACCOUNT": ("ACCOUNTNUM",),
        "EMAIL": ("EMAIL",),
        "PHONE": ("TELEPHONENUM",),
        "CREDIT_CARD": ("CREDITCARDNUMBER",),
        "SSN": ("SOCIALNUM",),
        "DATE": ("DATEOFBIRTH",),
        "MISC": ("TAXNUM", "DRIVERLICENSENUM", "IDCARDNUM"),
    },
}


def model_type(label: str, model: str = "ai4privacy") -> str:
    """SQL: the type of a model's normalised label, or null."""
    cases = " ".join(f"when {label} in ({', '.join(repr(x) for x in names)}) then '{kind}'" for kind, names in MODEL_LABELS[model].items())
    return f"case {cases} end"


class _Fold(dict):
    """Code points by what they are compared as: lower case without accents; marks alone are nothing."""

    def __missing__(self, code: int) -> str:
        self[code] = "".join(c for c in unicodedata.normalize("NFD", chr(code).lower()) if not unicodedata.category(c).startswith("M"))
        return self[code]


_FOLD = _Fold()
_BLANKS = np.array([c for c in range(0x3001) if chr(c).isspace()], np.uint32)


def folded(text: str) -> str:
    """Lower case without accents."""
    return text.translate(_FOLD)


class Squeezed:
    """A text without its blanks, folded.

    All pieces of a text one after the other, without their marks, are this string, so a piece begins
    where the lengths of those before add up to. ``starts`` and ``ends`` lead back to the text, and
    ``words`` tells which of its stretches between blanks a character belongs to.
    """

    def __init__(self, text: str):
        plain, home = folded(text), None
        if len(plain) != len(text):  # some characters became none or several
            sizes = np.array([len(_FOLD[ord(c)]) for c in text])
            home = np.repeat(np.arange(len(text)), sizes)
        codes = np.frombuffer(plain.encode("utf-32-le", "surrogatepass"), np.uint32)
        solid = np.flatnonzero(~np.isin(codes, _BLANKS))
        self.chars = "".join(plain.split())
        self.starts = solid if home is None else home[solid]
        # a character ends where the next one that is compared begins
        behind = np.append(np.arange(1, len(codes)), len(codes)) if home is None else np.append(home[1:], len(text))
        self.ends = behind[solid]
        self.words = np.cumsum(np.diff(solid, prepend=-1) > 1).tolist()

    def at(self, place: int) -> int:
        """The first character at or behind a place of the text."""
        return int(np.searchsorted(self.starts, place))


def align(text: str, pieces: list[str], framed: bool = True) -> list[tuple[int, int] | None]:
    """Place (start, end) of each piece in the text, null where it has none.

    A piece stands where the one before ended, blanks apart; one that does not stand there is looked
    for from there to ``REACH`` characters on, and where it is not found the next one goes on from the
    same place. Blanks inside a piece stand only where it has a mark. ``framed``: the first and the
    last piece may be control tokens that are not in the text.
    """
    starts, ends = placed(text, pieces, framed)
    return [None if b < 0 else (a, b) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def placed(text: str, pieces: list[str], framed: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of pieces as arrays, -1 where a piece has no place (see ``align``)."""
    wordpiece = next((p.startswith(INNER_MARK) for p in pieces if p[:1] == START_MARK or p[:2] == INNER_MARK), False)
    sq = Squeezed(text)
    chars, words, last = sq.chars, sq.words, len(pieces) - 1
    first, final = np.full(len(pieces), -1), np.full(len(pieces), -1)
    cursor, edge = 0, 0  # in the squeezed text; in the text
    if (wants := _folded_all(pieces, wordpiece)) is not None:
        return _end_to_end(sq, wants) or _one_by_one(sq, wants)
    for n, piece in enumerate(pieces):
        if piece in SPECIAL:
            frame = framed and (n == 0 and piece in STARTS or n == last and piece in ENDS)
            place = int(sq.starts[cursor]) if cursor < len(chars) else len(text)
            if not frame and text.startswith(piece, place):
                edge = place + len(piece)
                cursor = sq.at(edge)
            continue
        parts = [piece.removeprefix(INNER_MARK)] if wordpiece else piece.split(START_MARK)
        parts = [x for x in map(folded, parts) if x]
        want = "".join(parts)
        if not want:
            continue
        k = cursor if chars.startswith(want, cursor) else -1
        limit = None
        while True:
            if k < 0 or not _stands(words, k, parts):  # not there: the next place within reach
                limit = sq.at(edge + REACH + 1) if limit is None else limit
                k = chars.find(want, max(cursor, k + 1), limit + len(want) - 1)
                if k < 0:
                    break
                continue
            first[n], final[n] = k, k + len(want) - 1
            cursor = k + len(want)
            edge = int(sq.ends[cursor - 1])
            break
    hit = first >= 0
    first[hit], final[hit] = sq.starts[first[hit]], sq.ends[final[hit]]
    return first, final


def _folded_all(pieces: list[str], wordpiece: bool) -> list[str] | None:
    """Pieces without their marks, folded at once; null if some are control tokens or have marks inside."""
    if not pieces or not SPECIAL.isdisjoint(pieces):
        return None
    joined = "\n".join([p.removeprefix(INNER_MARK) if wordpiece else p.removeprefix(START_MARK) for p in pieces])
    if not wordpiece and START_MARK in joined or joined.count("\n") != len(pieces) - 1:
        return None
    return folded(joined).split("\n")


def _end_to_end(sq: Squeezed, wants: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
    """The places of pieces that fill the text one after the other, a blank inside none; null if they do not."""
    sizes = np.array([len(p) for p in wants])
    if not sizes.all() or "".join(wants) != sq.chars:
        return None
    final = np.cumsum(sizes) - 1
    first = final - sizes + 1
    words = np.array(sq.words)
    if (words[first] != words[final]).any():
        return None
    return sq.starts[first], sq.ends[final]


def _one_by_one(sq: Squeezed, wants: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The places of pieces that are one part each, in their order."""
    chars, words, first, final, cursor = sq.chars, sq.words, [], [], 0
    for want in wants:
        size, k = len(want), cursor
        if not size:
            k = -1
        elif not chars.startswith(want, k) or words[k] != words[k + size - 1]:  # not there: the next place within reach
            limit = sq.at((int(sq.ends[cursor - 1]) if cursor else 0) + REACH + 1) + size - 1
            while (k := chars.find(want, k, limit)) >= 0 and words[k] != words[k + size - 1]:
                k += 1
        first.append(k)
        final.append(k + size - 1 if k >= 0 else -1)
        if k >= 0:
            cursor = k + size
    first, final = np.array(first), np.array(final)
    hit = first >= 0
    first[hit], final[hit] = sq.starts[first[hit]], sq.ends[final[hit]]
    return first, final


def _stands(words: list[int], at: int, parts: list[str]) -> bool:
    """Whether no blank of the text is inside one of the parts that follow each other at ``at``."""
    for part in parts:
        if words[at] != words[at + len(part) - 1]:
            return False
        at += len(part)
    return True


def coverage(pieces: list[str], places: list[tuple[int, int] | None]) -> float:
    """Share of pieces with content that have a place; 1 without any."""
    content = [place is not None for piece, place in zip(pieces, places, strict=True) if piece not in SPECIAL and piece.strip(START_MARK)]
    return sum(content) / len(content) if content else 1.0


def bounds(places: str, text: str, most: int = MAX_TOKENS, overlap: int = OVERLAP_TOKENS) -> str:
    """SQL: (start, end) of chunks of at most ``most`` pieces, from the pieces' places.

    A chunk ends where a placed piece begins: the last one within the budget, else the first behind
    it. The next begins ``overlap`` pieces before that, at its first placed piece.
    """
    overlap = min(overlap, most - 1)
    kind = "array<struct<start:int,end:int>>"
    first_of = lambda a, b: f"array_min(filter(sequence({a}, {b}), i -> {places}[i] is not null))"
    size = f"size({places})"
    within = f"if(x.f + {most} >= {size}, {size}, coalesce(array_max(filter(sequence(x.f + 1, x.f + {most}), i -> {places}[i] is not null)), if(x.f + {most} + 1 < {size}, coalesce({first_of(f'x.f + {most} + 1', f'{size} - 1')}, {size}), {size})))"
    begin = f"if(x.f = 0, 0, coalesce({places}[{first_of('x.f', f'{size} - 1')}].start, 0))"
    chunk = f"named_struct('start', {begin}, 'end', if(cut < {size}, {places}[cut].start, char_length({text})))"
    step = let(within, "cut", f"named_struct('f', if(cut >= {size}, -1, greatest(x.f + 1, cut - {overlap})), 'out', concat(x.out, array({chunk})))")
    # each turn moves on by at least one piece, by most - overlap where pieces are placed
    turns = f"sequence(1, greatest({size}, 1))"
    fold = f"aggregate({turns}, named_struct('f', 0, 'out', cast(array() as {kind})), (x, turn_) -> if(x.f < 0, x, {step}), x -> x.out)"
    return f"if({size} = 0, cast(array() as {kind}), {fold})"


def cut_places(pieces: int, places: list[int | None], length: int, most: int, overlap: int) -> list[tuple[int, int]]:
    """The same bounds for one text whose pieces begin at ``places``."""
    on = np.array([i for i, p in enumerate(places) if p is not None], int)
    return cut_at(pieces, on, np.array([places[i] for i in on], int), length, most, overlap)


def cut_at(pieces: int, on: np.ndarray, starts: np.ndarray, length: int, most: int, overlap: int) -> list[tuple[int, int]]:
    """The same, from the numbers of the pieces that have a place and where these begin."""
    out, first = [], 0
    while first >= 0:
        here, behind = np.searchsorted(on, (first, first + most + 1))
        begin = 0 if first == 0 or here == len(on) else int(starts[here])
        # the last placed piece within the budget, else the first behind it
        at = behind - 1 if behind and on[behind - 1] > first else behind
        last = first + most >= pieces or at == len(on)
        out.append((begin, length if last else int(starts[at])))
        first = -1 if last else max(first + 1, int(on[at]) - overlap)
    return out


def token_bounds(text: str, tokenize: Tokenizer, most: int = MAX_TOKENS, overlap: int = OVERLAP_TOKENS) -> list[tuple[int, int]] | None:
    """(start, end) of one text's chunks (see ``bounds``); null if too few pieces have a place."""
    pieces = tokenize(text)
    places = align(text, pieces, framed=False)
    if not any(places) or coverage(pieces, places) < LEAST_PLACED:
        return None if text else []
    return cut_places(len(pieces), [p and p[0] for p in places], len(text), most, min(overlap, most - 1))


def fitted(text: str, tokenize: Tokenizer, most: int, start: int = 0) -> Iterator[tuple[int, int]]:
    """The text's bounds, halved with some overlap until each part has at most ``most`` pieces."""
    if len(tokenize(text)) <= most:
        yield start, start + len(text)
        return
    if len(text) < 2:
        raise ValueError("one character has more pieces than a chunk may have")
    middle, overlap = len(text) // 2, min(OVERLAP_CHARS // 2, len(text) // 4)
    yield from fitted(text[: middle + overlap], tokenize, most, start)
    yield from fitted(text[middle - overlap :], tokenize, most, start + middle - overlap)


def token_chunks(docs: DataFrame, tokenize: Tokenizer, key: str = "doc_id", text: str = "text", most: int = MAX_TOKENS, overlap: int = OVERLAP_TOKENS) -> DataFrame:
    """key, chunk, text and its start and end in characters and bytes: chunks within a token budget.

    Texts of which less than ``LEAST_PLACED`` of the pieces can be placed are halved until they fit.
    """

    @F.arrow_udf("array<string>")
    def pieces(texts: pa.Array) -> pa.Array:
        return pa.array([tokenize(t.as_py()) for t in texts], pa.list_(pa.string()))

    @F.arrow_udf("array<struct<start:int,end:int>>")
    def halves(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        return pa.array([None if t.as_py() is None else [{"start": a, "end": b} for a, b in fitted(t.as_py(), tokenize, most)] for t in texts], kind)

    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("pieces", pieces("text"))
    return chunked(aligned(rows, framed=False), most, overlap, halves).withColumnRenamed("key", key)


def chunked(rows: DataFrame, most: int = MAX_TOKENS, overlap: int = OVERLAP_TOKENS, halves: Callable | None = None) -> DataFrame:
    """Chunks (key, chunk, text and its bounds) of aligned rows (key, text, places, placed)."""
    enough = f"placed >= {LEAST_PLACED}D and exists(places, p -> p is not null)"

    @F.arrow_udf("array<struct<start:int,end:int>>")
    def cut(places: pa.Array, lengths: pa.Array) -> pa.Array:
        out = []
        for p, n in zip(places, lengths, strict=True):
            if not p.is_valid:
                out.append(None)
                continue
            on = np.flatnonzero(p.values.is_valid().to_numpy(zero_copy_only=False))
            starts = p.values.field("start").to_numpy(zero_copy_only=False)[on].astype(int)
            out.append([{"start": a, "end": b} for a, b in (cut_at(len(p), on, starts, n.as_py(), most, min(overlap, most - 1)) if len(p) else ())])
        return pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))

    # a fold in SQL copies the chunks so far at every piece
    rows = rows.withColumn("_b", cut(F.when(F.expr(f"text = '' or {enough}"), F.expr("if(text = '', slice(places, 1, 0), places)")), F.length("text")))
    if halves is not None:
        rows = rows.withColumn("_b", F.coalesce("_b", halves(F.when(F.col("_b").isNull(), F.col("text")))))
    # outer: for a plain generator Spark puts a filter on the bounds, and with it all before them, below the scan's shuffle
    out = rows.select("key", "text", F.posexplode_outer("_b").alias("chunk", "b")).filter("chunk is not null")
    cut = out.select("key", "chunk", F.expr("substring(text, b.start + 1, b.end - b.start)").alias("part"), F.col("b.start").alias("start_char"), F.col("b.end").alias("end_char"), F.expr("octet_length(substring(text, 1, b.start))").alias("start_byte"))
    return cut.select("key", "chunk", F.col("part").alias("text"), "start_char", "end_char", "start_byte", (F.col("start_byte") + F.octet_length("part")).alias("end_byte"))


def aligned(rows: DataFrame, text: str = "text", pieces: str = "pieces", framed: bool = True) -> DataFrame:
    """Add ``places`` (struct of start and end for each piece, or null) and ``placed`` (share of pieces with a place)."""

    @F.arrow_udf("struct<places:array<struct<start:int,end:int>>,placed:double>")
    def place(texts: pa.Array, lists: pa.Array) -> pa.Array:
        starts, ends, sizes, share = [], [], [0], []
        for t, p in zip(texts, lists, strict=True):
            own = p.as_py() or []
            a, b = placed(t.as_py() or "", own, framed)
            content = np.array([x not in SPECIAL and bool(x.strip(START_MARK)) for x in own], bool)
            share.append(float((b[content] >= 0).mean()) if content.any() else 1.0)
            starts.append(a)
            ends.append(b)
            sizes.append(sizes[-1] + len(own))
        a, b = (np.concatenate([*x, np.empty(0, np.int64)]).astype(np.int32) for x in (starts, ends))
        each = pa.StructArray.from_arrays([pa.array(a), pa.array(b)], names=["start", "end"], mask=pa.array(b < 0))
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), each), pa.array(share, pa.float64())], names=["places", "placed"])

    return rows.withColumn("_a", place(F.col(text), F.col(pieces))).select("*", "_a.*").drop("_a")


def predictions(items: str, places: str, model: str = "ai4privacy") -> str:
    """SQL: typed, placed predictions (start, end, entity_type, score) of a model's items (index, label, score)."""
    one = let(f"get({places}, p.index)", "r", let(model_type("n", model), "k", "named_struct('start', r.start, 'end', r.end, 'entity_type', k, 'score', p.score)"))
    one = let(ner_label("p.label"), "n", one)
    return f"filter(transform(filter({items}, p -> p.index is not null), p -> {one}), x -> x.entity_type is not null and x.start < x.end)"


# How far apart halves of a value may be, how many spans back, and the types that a mail domain is taken for.
_BRIDGE = r"^[\\p{L}\\p{N}_.\\-+@]{0,16}$"
_LOOK_BACK = 3
_TAILS = ("ORGANIZATION", "URL", "LOCATION", "MISC")
_DOMAIN = r"^[\\p{L}\\p{N}](?:[\\p{L}\\p{N}.\\-]*[\\p{L}\\p{N}])?"
_WORD = r"[\\p{L}\\p{N}]"
#: Bytes of the longest stretch between halves: sixteen characters.
_APART = 64


def _cut(a: str, b: str) -> str:
    """SQL: the text between two byte places of the binary ``bb``."""
    return f"cast(substring(bb, {a} + 1, {b} - ({a})) as string)"


def _with(s: str, **other: str) -> str:
    """SQL: a span with some fields changed."""
    return "named_struct(" + ", ".join(f"'{f}', {other.get(f, f'{s}.{f}')}" for f in ("start", "end", "entity_type", "score", "text", "source")) + ")"


def rejoined(spans: str, text: str, least: dict[str, float]) -> str:
    """SQL: NER spans by start with halves of a value rejoined.

    A span is taken into one of its type among the three kept last, the latest first, if at most
    sixteen word characters or ``.-+@`` lie between, the better score reaches the type's least one,
    and no kept span of another type that reaches its own least score stands in the way. Kept spans
    that the longer one covers go.
    """
    known = "map(" + ", ".join(f"{quoted(k)}, {v}D" for k, v in (least or {"": 0.0}).items()) + ")"
    mark = lambda x: f"coalesce(least[{x}.entity_type], 0D)"
    after = "slice(kept, j + 2, size(kept))"
    rival = f"exists({after}, x -> x.entity_type != kept[j].entity_type and x.start < s.end and x.end > kept[j].end and x.score >= {mark('x')})"
    fits = f"kept[j].entity_type = s.entity_type and kept[j].end <= s.start and s.start - kept[j].end <= {_APART} and greatest(kept[j].score, s.score) >= {mark('s')} and rlike({_cut('kept[j].end', 's.start')}, '{_BRIDGE}') and not {rival}"
    into = f"get(filter(sequence(size(kept) - 1, greatest(size(kept) - {_LOOK_BACK}, 0)), j -> {fits}), 0)"
    longer = _with("kept[j]", end="s.end", score="greatest(kept[j].score, s.score)")
    join = f"concat(slice(kept, 1, j), array({longer}), filter({after}, x -> x.end > s.end))"
    step = f"if(size(kept) = 0, array(s), {let(into, 'j', f'if(j is null, concat(kept, array(s)), {join})')})"
    fold = lambda part: f"aggregate({part}, cast(array() as array<{SPAN}>), (kept, s) -> {step})"
    order = "if(a.start != b.start, a.start - b.start, a.end - b.end)"
    body = islands(f"array_sort({spans}, (a, b) -> {order})", fold, apart=_APART)
    return let(f"cast({text} as binary)", "bb", let(known, "least", body))


def with_domains(spans: str, text: str, least: float) -> str:
    """SQL: spans by start; one that follows a confident mail address's ``@`` gives it its domain, and what is left stays a span."""
    kinds = ", ".join(map(quoted, _TAILS))
    own, last = _cut("s.start", "s.end"), "get(kept, size(kept) - 1)"
    # the address ends with the sign, or it alone lies between
    joint = f"if(l.end = s.start, {_cut('l.end - 1', 'l.end')}, {_cut('l.end', 's.start')}) = '@'"
    fits = f"l.entity_type = 'EMAIL' and s.entity_type in ({kinds}) and l.end <= s.start and l.score >= {least}D and {joint} and rlike(own, '{_DOMAIN}')"
    end = f"s.start + octet_length(regexp_extract(own, '{_DOMAIN}', 0))"
    rest = f"regexp_replace(own, '{_DOMAIN}', '')"
    left = _with("s", start="s.end - octet_length(regexp_replace(rest, '^\\\\s+', ''))")
    taken = let(rest, "rest", f"concat(slice(kept, 1, size(kept) - 1), array({_with('l', end=end)}), if(rlike(rest, '{_WORD}'), array({left}), cast(array() as array<{SPAN}>)))")
    step = let(last, "l", let(own, "own", f"if(coalesce({fits}, false), {taken}, concat(kept, array(s)))"))
    fold = lambda part: f"aggregate({part}, cast(array() as array<{SPAN}>), (kept, s) -> {step})"
    return let(f"cast({text} as binary)", "bb", islands(spans, fold, apart=_APART))


def repaired(rows: DataFrame, spans: str, text: str = "text", least: dict[str, float] | None = None) -> DataFrame:
    """Rows with their NER spans repaired (see ``rejoined`` and ``with_domains``); ``least`` are the model's thresholds."""
    marks = least if least is not None else {t[0]: t[4] for t in TYPES}
    body = f"coalesce({text}, '')"
    out = rows.withColumn(spans, F.expr(rejoined(spans, body, marks)))
    out = out.withColumn(spans, F.expr(with_domains(spans, body, marks.get("EMAIL", 0.0))))
    sliced = f"transform({spans}, s -> {_with('s', text=_cut('s.start', 's.end'))})"
    return out.withColumn(spans, F.expr(let(f"cast({body} as binary)", "bb", sliced)))


def labelled(spans: DataFrame, raw: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Exploded spans with the raw label that a model gave to the same bounds and type; the last of several."""
    keys = [doc, "start", "end", "entity_type"]
    return spans.join(raw.groupBy(*keys).agg(F.max_by("raw_label", "seq").alias("raw_label")), keys, "left")


_JOINT = r"^[\\s._@:/+\\-(),]{0,4}$"
_INNER = r"[\\p{L}\\p{N}_-]"


def spellings(word: str) -> str:
    """SQL: a word as a model writes it in lower case, then without the blanks around marks, without any blanks, with single ones."""
    forms = "array(w, regexp_replace(w, '\\\\s*([_@:/.-])\\\\s*', '$1'), regexp_replace(w, '\\\\s+', ''), regexp_replace(w, '\\\\s+', ' '))"
    return let(f"lower(trim(regexp_replace({word}, '^{INNER_MARK}', '')))", "w", f"filter(array_distinct({forms}), x -> x != '')")


def searched(items: str, text: str) -> str:
    """SQL: spans (start, end, entity_type, score in characters) of an array of (word, entity_type, score) without offsets.

    Each word is searched behind the one before, in its first spelling that is there. Neighbours of a
    type join over at most four blanks and marks with the higher score; spans grow to whole words.
    """
    kind = "array<struct<start:int,end:int,entity_type:string,score:double>>"
    tried = f"transform({spellings('p.word')}, x -> named_struct('at', locate(x, low, a.cursor + 1), 'n', char_length(x)))"
    hit = f"get(filter({tried}, x -> x.at > 0), 0)"
    new = "named_struct('start', h.at - 1, 'end', h.at - 1 + h.n, 'entity_type', p.entity_type, 'score', cast(p.score as double))"
    joins = f"l.entity_type = p.entity_type and rlike(substring({text}, l.end + 1, h.at - 1 - l.end), '{_JOINT}')"
    longer = "named_struct('start', l.start, 'end', h.at - 1 + h.n, 'entity_type', l.entity_type, 'score', greatest(l.score, cast(p.score as double)))"
    grow = let("get(a.out, size(a.out) - 1)", "l", f"if(coalesce({joins}, false), concat(slice(a.out, 1, size(a.out) - 1), array({longer})), concat(a.out, array({new})))")
    step = let(hit, "h", f"if(h is null, a, named_struct('cursor', h.at - 1 + h.n, 'out', {grow}))")
    found = f"aggregate({items}, named_struct('cursor', 0, 'out', cast(array() as {kind})), (a, p) -> {step}, a -> a.out)"
    start = f"s.start - char_length(regexp_extract(substring({text}, 1, s.start), '{_INNER}*$', 0))"
    end = f"s.end + char_length(regexp_extract(substring({text}, s.end + 1), '^{_INNER}*', 0))"
    whole = f"transform({found}, s -> named_struct('start', {start}, 'end', {end}, 'entity_type', s.entity_type, 'score', s.score))"
    return let(f"lower({text})", "low", whole)
