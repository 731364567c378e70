"""Personal data by weak supervision, in DataFrame and SQL expressions only.

Candidate spans come from four fixed patterns (the base) and from wider ones (obfuscated e-mail, IPv6, national phone
numbers). Labelers vote on each candidate (1 yes, -1 no, 0 abstains and says nothing): the strict pattern, a
checksum, range or form test, gazetteers (top-level domains, calling codes, card issuers), the words
to its left, its surroundings and its grouping. Votes and a few surface
features are counted per pattern of values; there are at most a few thousand such patterns
whatever the corpus, so that table alone reaches the driver. There, expectation-
maximisation estimates each labeler's reliabilities and each pattern's
probability: base spans are known to be personal data, strict matches that fail their checksum or range
known not to be, and the wider candidates are what is estimated. A final span classifier (naive Bayes over votes and
surface features) is trained on these probabilities. Base spans always stay; wider candidates are added where the classifier
is sure and they overlap no base span. A strict match that fails its test is never added.

Each pattern runs once over a text: its matches are set off by a separator and the text is split there, and positions are prefix
sums of the pieces' lengths, in blocks of BLOCK, so the work grows with the text and not with the square of its matches.
Candidates are written once and read for both passes, counting and classifying. Patterns are written with possessive runs
and look-behind so that a long run of one class is scanned once; they accept the same leftmost spans as the plain forms in
BASE (card: of those that can have 12 digits).

Defined results: null text is the empty text; texts without candidates have empty span lists;
positions are code points; an empty table trains nothing and gives an empty result; rows that repeat are searched alike.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

KINDS = ("email", "ip", "card", "phone")
#: The base patterns as users state them.
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: The same languages and leftmost matches, without backtracking over long runs; a card's run has 12 digits at least.
_SCAN = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Further candidates.
_WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:\[at\]|\(at\)) ?[A-Za-z0-9-]++(?: ?(?:\[dot\]|\(dot\)|\.) ?[A-Za-z0-9-]++)++",
    "ip": (
        r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}"
        r"|(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?+::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?+)(?![0-9A-Za-z:])"
    ),
    # North American; with a trunk zero (German, French, British and others); of three groups of three, as in Spain.
    "phone": (
        r"(?<![0-9A-Za-z+(.,/-])(?<!\+[0-9] ?)(?:\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}"
        r"|\(?0[1-9][0-9]{0,3}\)?[ /.-][0-9]{2,8}(?:[ .-][0-9]{2,4}){0,4}"
        r"|[6-9][0-9]{2}[ .-][0-9]{3}[ .-][0-9]{3})(?![0-9A-Za-z]|[.,/-][0-9])"
    ),
}
#: What a text must hold for a pattern to be tried.
_GUARD = {
    ("email", True): "contains(_t, '@')",
    ("ip", True): "_digits and contains(_t, '.')",
    ("card", True): "_digits",
    ("phone", True): "contains(_t, '+')",
    ("email", False): "contains(_t, '[at]') or contains(_t, '(at)')",
    ("ip", False): "contains(_t, ':')",
    ("phone", False): "_digits",
}
#: Sets matches off; in the searched text, another control character stands in its place.
_MARK, _OTHER = "\x01", "\x02"
#: Elements that one step of a prefix sum appends to; three steps are made, so sums of up to BLOCK ** 3 pieces take linear time.
BLOCK = 64


@dataclass(frozen=True)
class Gazetteers:
    """Lists that the labelers look up, each an alternation: parameters for callers with fuller public lists.

    Fixed values by default: generic top-level domains beside all of two letters (country codes), calling codes, first
    digits of card issuers, and words beside personal data, by kind, and beside other numbers.
    """

    top_domains: str = "[a-z]{2}|com|org|net|edu|gov|mil|int|info|biz|name|pro|aero|coop|museum|jobs|mobi|travel|tel|cat|asia|app|dev|online|site|shop|cloud|tech|xyz|email|blog|example|test|invalid|local"
    calling_codes: str = (
        "1|7|20|27|30|31|32|33|34|36|39|40|41|43|44|45|46|47|48|49|51|52|53|54|55|56|57|58|60|61|62|63|64|65|66|81|82|84|86|90|91|92|93|94|95|98"
        "|21[1-368]|2[2-6][0-9]|29[0-17-9]|35[0-9]|37[0-8]|38[0-25-79]|42[013]|50[0-9]|59[0-9]|67[02-9]|68[0-35-9]|69[0-2]|85[02356]|88[06]|96[0-8]|97[0-7]|99[2-68]"
    )
    card_issuers: str = "4|5[0-8]|3[0468-9]|35|37|6[0-9]|2[2-7]|62|81"
    near: tuple[str, ...] = (
        "e-?mail|mail|contact|write|address|kontakt|correo|courriel|adresse",
        "ip|ipv4|ipv6|host|server|address|adresse|dirección|gateway|subnet|ping",
        "card|visa|mastercard|amex|credit|debit|konto|karte|kreditkarte|carte|tarjeta|payment",
        "tel|phone|call|fax|mobile|cell|telefon|téléphone|teléfono|móvil|handy|dial|hotline|whatsapp",
    )
    far: str = "version|release|isbn|issn|section|chapter|order|invoice|article|figure|page|id|serial|part|ref|build|sku|rfc"


LABELERS = ("v_regex", "v_check", "v_gazetteer", "v_context", "v_edges", "v_groups")
FEATURES = ("f_length", "f_left", "f_right", "f_first")
THRESHOLD = 0.9
ROUNDS = 30
_OCTET = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
_VALID_IP = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"


def _q(pattern: str) -> str:
    return "r'" + pattern.replace("'", r"\x27") + "'"


def _scanned(values: str, larger: bool = False) -> str:
    """Running sums (larger: maxima) of an array of ints, with 0 before the first."""
    step = "greatest(element_at(s, -1), v)" if larger else "element_at(s, -1) + v"
    return f"aggregate({values}, array(0), (s, v) -> array_append(s, {step}))"


def _with_prefix(d: DataFrame, values: dict[str, str], larger: bool = False) -> DataFrame:
    """d with `{name}_1` to `{name}_3` for each array of ints: running sums within blocks, of blocks, and of blocks of blocks."""
    blocks = lambda a, x: f"transform(sequence(0, (size({a}) - 1) div {BLOCK}), b -> {x.format(f'slice({a}, cast(b * {BLOCK} + 1 as int), {BLOCK})')})"
    none = "cast(array() as array<array<int>>)"
    last = "transform({}, p -> element_at(p, -1))"
    one = {f"{n}_1": F.expr(f"case when {a} is null or size({a}) = 0 then {none} else {blocks(a, _scanned('{}', larger))} end") for n, a in values.items()}
    two = {f"{n}_2": F.expr(f"case when size({n}_1) = 0 then {none} else {blocks(f'{n}_1', _scanned(last, larger))} end") for n in values}
    three = {f"{n}_3": F.expr(_scanned(last.format(f"{n}_2"), larger)) for n in values}
    return d.withColumns(one).withColumns(two).withColumns(three)


def _prefix(name: str, k: str, larger: bool = False) -> str:
    """The running sum (maximum) of the first k values."""
    parts = [f"coalesce(get({name}_3, shiftright({k}, 12)), 0)", f"coalesce(get(get({name}_2, shiftright({k}, 12)), shiftright({k}, 6) & 63), 0)", f"coalesce(get(get({name}_1, shiftright({k}, 6)), {k} & 63), 0)"]
    return f"greatest({', '.join(parts)})" if larger else f"({' + '.join(parts)})"


_SPAN = "struct<start:int,k:int,end:int,text:string,left:string,right:string,strict:boolean>"
_WITH_OK = "named_struct('start', x.start, 'k', x.k, 'end', x.end, 'text', x.text, 'left', x.left, 'right', x.right, 'strict', x.strict, 'ok', "
_DIGITS = "regexp_replace(x.text, '[^0-9]', '')"
_LUHN = (
    f"aggregate(transform(split(reverse({_DIGITS}), ''), (c, i) -> case when i % 2 = 0 then coalesce(cast(c as int), 0) when cast(c as int) > 4 then cast(c as int) * 2 - 9 else coalesce(cast(c as int), 0) * 2 end), 0, (a, c) -> a + c) % 10 = 0"
)
_CHECKED = (
    f"case x.k when 0 then true when 1 then x.text rlike {_q(_VALID_IP)} when 2 then length({_DIGITS}) between 12 and 19 and {_LUHN} else length({_DIGITS}) between 9 and 15 end"
)
#: The form of wide candidates: a top-level label of letters; IPv6 of two to eight groups with a digit other than 0; phone numbers
#: whose area and exchange codes begin with 2 to 9, or with a trunk zero and nine to twelve digits, or nine digits from 6 on.
_WIDE_CHECKED = (
    f"case x.k when 0 then x.text rlike {_q(r'[.)\]] ?[A-Za-z]{2,}$')} "
    f"when 1 then x.text rlike '[0-9]' and x.text rlike '[1-9A-Fa-f]' and size(filter(split(x.text, ':'), g -> g != '')) between 2 and 8 "
    f"when 3 then case when x.text rlike {_q(r'^\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}$')} "
    f"then {_DIGITS} rlike {_q('^[2-9][0-9]{2}[2-9][0-9]{6}$')} else {_DIGITS} rlike {_q('^(?:0[1-9][0-9]{7,10}|[6-9][0-9]{8})$')} end else false end"
)
#: Code points that a labeler sees to the left and to the right of a candidate.
LEFT, RIGHT = 40, 16


def votes(lists: Gazetteers) -> dict[str, str]:
    """What each labeler says of a candidate x, as SQL: 1, -1, or 0 for nothing. Patterns stand in raw literals."""
    word = lambda words: rf"(?<![\p{{L}}])({words})(?![\p{{L}}])"
    # Beside it: to the left without a word between, or right behind it in brackets or after a comma.
    left = lambda words: f"lower(x.left) rlike {_q(word(words) + r'[^\p{L}]*$')}"
    right = lambda words: f"lower(x.right) rlike {_q(r'^[ ,;]{0,2}[(\[]?' + word(words))}"
    near = " ".join(f"when {i} then {left(w)} or {right(w)}" for i, w in enumerate(lists.near))
    top, code = _q(rf"(?:[.]|[)]|[]]) ?({lists.top_domains})$"), _q(rf"^[+]({lists.calling_codes})[^0-9]")
    issuer, inner = _q(f"^({lists.card_issuers})"), _q(r"^(0|127|255)[.]")
    return {
        "v_regex": "case when x.strict then 1 else 0 end",
        "v_check": f"case when x.ok or (not x.strict and {_WIDE_CHECKED}) then 1 else -1 end",
        "v_gazetteer": (
            f"case x.k when 0 then case when lower(x.text) rlike {top} then 1 else -1 end "
            f"when 1 then case when x.text rlike {inner} then -1 else 0 end "
            f"when 2 then case when x.text rlike {issuer} then 1 else -1 end "
            f"else case when x.strict and x.text rlike {code} then 1 else 0 end end"
        ),
        "v_context": f"case when case x.k {near} end then 1 when {left(lists.far)} then -1 else 0 end",
        "v_edges": (
            f"case when (x.left = '' or x.left rlike {_q(r'[\s(<\[\"|:]$')}) "
            f"and (x.right = '' or x.right rlike {_q(r'^[\s.,;:)>\]\"!?|]')}) then 1 else -1 end"
        ),
        "v_groups": (
            f"case x.k when 2 then case when x.text rlike {_q('^(?:[0-9]{13,19}|[0-9]{4}([ -][0-9]{4}){3})$')} then 1 else -1 end "
            f"when 3 then case when x.text rlike {_q('[0-9][ ()./-]+[0-9]')} then 1 else -1 end else 0 end"
        ),
    }


def features() -> dict[str, str]:
    """Surface features of a candidate x, as SQL: small numbers."""
    beside = lambda side, at: (
        f"case when x.{side} = '' then 0 when x.{side} rlike {_q(at.format(r'\s'))} then 1 "
        f"when x.{side} rlike {_q(at.format('[0-9]'))} then 2 when x.{side} rlike {_q(at.format('[A-Za-z]'))} then 3 else 4 end"
    )
    return {
        "f_length": "least(7, cast(length(x.text) / 4 as int))",
        "f_left": beside("left", "{}$"),
        "f_right": beside("right", "^{}"),
        "f_first": f"case when x.text rlike {_q('^[0-9]')} then 0 when x.text rlike {_q('^[A-Za-z]')} then 1 else 2 end",
    }


def _found(kind: str, base: bool, name: str) -> Column:
    """Spans of a pattern from the pieces `{name}` of the text (gap, match, gap, ..., gap) and the running sums of their lengths."""
    return F.expr(
        f"case when {name} is null or size({name}) < 3 then cast(array() as array<{_SPAN}>) else transform(sequence(1, size({name}) - 1, 2), i -> "
        f"named_struct('start', {_prefix(name, 'i')}, 'k', {KINDS.index(kind)}, 'end', {_prefix(name, '(i + 1)')}, "
        f"'text', {name}[i], 'left', right({name}[i - 1], {LEFT}), 'right', left({name}[i + 1], {RIGHT}), 'strict', {str(base).lower()})) end"
    )


def _candidates(docs: DataFrame, *keep: str, lists: Gazetteers | None = None) -> DataFrame:
    """keep columns and `_c`: candidates with their place, whether they are base spans, and `pattern`, their votes and features."""
    lists = lists or Gazetteers()
    d = docs.select(*[F.col(c) for c in keep], F.translate(F.coalesce("text", F.lit("")), _MARK, _OTHER).alias("_t")).withColumn("_digits", F.col("_t").rlike("[0-9]"))
    tried = [(f"_p{i}", k, True, _SCAN[k]) for i, k in enumerate(KINDS)] + [(f"_q{i}", k, False, _WIDE[k]) for i, k in enumerate(KINDS) if k in _WIDE]
    marked = lambda p: F.split(F.regexp_replace("_t", F.lit(p), F.lit(f"{_MARK}$0{_MARK}")), _MARK, -1)
    d = d.withColumns({n: F.when(F.expr(_GUARD[k, base]), marked(p)) for n, k, base, p in tried})
    d = _with_prefix(d, {n: f"transform({n}, x -> length(x))" for n, *_ in tried})
    strict = "concat(" + ",".join(n.replace("_p", "_b") for n, _, base, _ in tried if base) + ")"
    wide = "concat(" + ",".join(n.replace("_q", "_w") for n, _, base, _ in tried if not base) + ")"
    d = d.withColumns({n.replace("_p", "_b").replace("_q", "_w"): _found(k, base, n) for n, k, base, _ in tried})
    d = d.withColumn("_s", F.expr(f"transform({strict}, x -> {_WITH_OK}{_CHECKED}))"))
    d = d.withColumn("_x", F.expr(f"transform({wide}, x -> {_WITH_OK}false))"))
    pattern = "concat_ws(' ', x.k, x.ok, " + ", ".join([*votes(lists).values(), *features().values()]) + ")"
    all_ = f"transform(concat(_s, _x), x -> named_struct('start', x.start, 'k', x.k, 'end', x.end, 'ok', x.ok, 'pattern', {pattern}))"
    return d.select(*keep, F.expr(f"case when size(_s) + size(_x) = 0 then cast(array() as array<struct<start:int,k:int,end:int,ok:boolean,pattern:string>>) else {all_} end").alias("_c"))


def pattern_counts(candidates: DataFrame) -> dict[str, int]:
    """How often each pattern of votes and features occurs: a table whose size depends on the labelers, not on the corpus."""
    per = candidates.select(F.explode("_c.pattern").alias("pattern")).groupBy("pattern").count()
    return {r["pattern"]: r["count"] for r in per.collect()}


def anchor(pattern: str) -> int | None:
    """1: a base span; 0: a strict match that failed its test; None: unknown, to be estimated."""
    parts = pattern.split(" ")
    return 1 if parts[1] == "true" else 0 if parts[2] == "1" else None


def reliabilities(counts: dict[str, int], rounds: int = ROUNDS) -> dict[str, float]:
    """Expectation-maximisation per kind: each pattern's probability to be personal data.

    Every labeler has P(vote | class, it votes) for both classes, smoothed by one count; an abstention says nothing. Base spans
    and failed tests keep probability 1 and 0; others start from the majority of their votes, and their own share gives the
    odds before any vote. Deterministic: patterns are visited in sorted order.
    """
    out: dict[str, float] = {}
    for kind in sorted({p.split(" ")[0] for p in counts}):
        names = [p for p in sorted(counts) if p.split(" ")[0] == kind]
        known = [anchor(p) for p in names]
        votes = [{(i, v) for i, v in enumerate(p.split(" ")[2 : 2 + len(LABELERS)]) if v != "0"} for p in names]
        q = [1 / (1 + math.exp(-sum(int(v) for _, v in of))) if a is None else float(a) for of, a in zip(votes, known, strict=True)]
        for _ in range(rounds):
            new = _bayes(votes, [counts[p] for p in names], q, known)
            q = [x if a is None else float(a) for x, a in zip(new, known, strict=True)]
        out |= dict(zip(names, q, strict=True))
    return out


def _bayes(rows: list[set[tuple[int, str]]], n: list[int], q: list[float], known: list[int | None]) -> list[float]:
    """One step: fit P(value | class) per place from soft labels, and give the posterior of each row."""
    table: dict[int, dict[str, list[float]]] = defaultdict(lambda: defaultdict(lambda: [1.0, 1.0]))
    open_ = [1.0, 1.0]
    for row, count, x, a in zip(rows, n, q, known, strict=True):
        for i, value in sorted(row):
            table[i][value][0] += count * (1 - x)
            table[i][value][1] += count * x
        if a is None:
            open_[0] += count * (1 - x)
            open_[1] += count * x
    for of in table.values():  # a vote that nobody cast counts as seen once
        if set(of) in ({"1"}, {"-1"}):
            of["-1" if "1" in of else "1"]
    total = {i: [sum(c[y] for c in of.values()) for y in (0, 1)] for i, of in table.items()}
    out = []
    for row in rows:
        odds = math.log(open_[1] / open_[0])
        for i, value in sorted(row):
            no, yes = table[i][value]
            odds += math.log(yes / total[i][1]) - math.log(no / total[i][0])
        out.append(1 / (1 + math.exp(-max(-60.0, min(60.0, odds)))))
    return out


def classifier(counts: dict[str, int]) -> dict[str, float]:
    """The final span classifier's probability of each pattern: naive Bayes over votes and surface features, trained on the EM posteriors.

    Votes are shared by all candidates of a kind; features are told apart for strict and wide ones, whose forms differ.
    """
    soft = reliabilities(counts)
    out: dict[str, float] = {}
    for kind in sorted({p.split(" ")[0] for p in counts}):
        names = [p for p in sorted(counts) if p.split(" ")[0] == kind]
        rows = []
        for p in names:
            votes, features = p.split(" ")[2 : 2 + len(LABELERS)], p.split(" ")[2 + len(LABELERS) :]
            shift = len(LABELERS) + len(FEATURES) * (votes[0] == "1")
            rows.append({(i, v) for i, v in enumerate(votes) if v != "0"} | {(shift + i, f"f{v}") for i, v in enumerate(features)})
        out |= dict(zip(names, _bayes(rows, [counts[p] for p in names], [soft[p] for p in names], [anchor(p) for p in names]), strict=True))
    return out


def find_spans(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), threshold: float = THRESHOLD, lists: Gazetteers | None = None) -> DataFrame:
    """keep columns, `base` and `spans`: arrays of (start, k, end) by start and kind; spans holds the base and what the classifier adds."""
    found = cut(_candidates(docs, *keep, lists=lists), "pii-candidates")
    scores = classifier(pattern_counts(found))
    sure = [p for p, x in sorted(scores.items()) if x >= threshold and anchor(p) is None]
    place = "x -> struct(x.start, x.k, x.end)"
    named = found.withColumn("base", F.expr(f"array_sort(transform(filter(_c, x -> x.ok), {place}))"))
    if not sure:
        return named.select(*keep, "base", F.col("base").alias("spans"))
    listed = ", ".join(f"'{p}'" for p in sure)
    named = named.withColumn("_more", F.expr(f"transform(filter(_c, x -> not x.ok and x.pattern in ({listed})), {place})"))
    # Base spans in blocks by their start, each with its reach: a candidate looks into the blocks that it may overlap.
    reach = "named_struct('lo', y[0].start, 'hi', array_max(transform(y, b -> b.end)), 'of', y)"
    blocks = f"transform(transform(sequence(0, (size(base) - 1) div 256), j -> slice(base, cast(j * 256 + 1 as int), 256)), y -> {reach})"
    named = named.withColumn("_blocks", F.expr(f"case when size(_more) > 0 and size(base) > 0 then {blocks} end"))
    free = "filter(_more, x -> not coalesce(exists(_blocks, y -> y.lo < x.end and x.start < y.hi and exists(y.of, b -> b.start < x.end and x.start < b.end)), false))"
    return named.select(*keep, "base", F.expr(f"case when size(_more) = 0 then base else array_sort(array_distinct(concat(base, {free}))) end").alias("spans"))


def joined(spans: str) -> Column:
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return F.expr(f"array_join(transform({spans}, x -> concat({names}[x.k], ':', x.start, ':', x.end)), ',')")


def report(found: DataFrame) -> DataFrame:
    counts = [F.expr(f"cast(size(filter(base, x -> x.k = {i})) as bigint)").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


#: Code points of the pieces in which redact() holds a text.
PIECE = 1024


def redact(docs: DataFrame, threshold: float = THRESHOLD, lists: Gazetteers | None = None) -> DataFrame:
    """docs with every span of its text replaced by its kind in angle brackets; n_chars follows. Rows without spans stay as they are.

    Overlapping spans are replaced from the left; one that begins inside a replaced span goes with it.
    """
    # The row travels as one struct, so no column of the caller can clash with those of the search.
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("text"))
    found = find_spans(whole, ("_row",), threshold, lists)
    names = "array(" + ", ".join(f"'<{k.upper()}>'" for k in KINDS) + ")"
    found = _with_prefix(found, {"_end": "transform(spans, x -> x.end)"}, larger=True)
    found = found.withColumn("_pieces", F.when(F.size("spans") > 0, F.regexp_extract_all(F.col("_row.text"), F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))))

    def between(a: str, b: str) -> str:
        """The text from code point a to b, out of the pieces."""
        inner = f"array_join(slice(_pieces, cast({a} div {PIECE} + 2 as int), cast({b} div {PIECE} - {a} div {PIECE} - 1 as int)), '')"
        part = lambda k: f"coalesce(get(_pieces, cast({k} div {PIECE} as int)), '')"
        return (
            f"case when {a} div {PIECE} = {b} div {PIECE} then substring({part(a)}, {a} % {PIECE} + 1, {b} - {a}) "
            f"else concat(substring({part(a)}, {a} % {PIECE} + 1, {PIECE}), {inner}, substring({part(b)}, 1, {b} % {PIECE})) end"
        )

    before = _prefix("_end", "i", larger=True)
    each = f"transform(spans, (x, i) -> case when x.start < {before} then '' else concat({between(before, 'x.start')}, {names}[x.k]) end)"
    # A text has size(_pieces) * PIECE code points at most; the rest behind the last span is asked for up to there.
    tail = between(_prefix("_end", "size(spans)", larger=True), f"(size(_pieces) * {PIECE})")
    found = found.withColumn("_text", F.expr(f"case when size(spans) = 0 then _row.text else concat(array_join({each}, ''), {tail}) end"))
    changed = {"text": F.col("_text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.size("spans") > 0, F.length("_text")).otherwise(F.col("_row.n_chars")).cast(docs.schema["n_chars"].dataType)
    return found.select(*[changed.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])
