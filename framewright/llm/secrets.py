"""Secret scans with column expressions only.

Three fixed kinds are found by pattern. The fourth slides a window over every candidate string and keeps
the Shannon entropy of the window by incremental counts: a character that enters or leaves changes one count and
one term of the sum. What an allow-list names is left out. Everything is local to a row: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.base import query, table

# Fixed patterns of the base kinds. A failing match of `assign` still takes its text from later ones, hence the
# check of its length comes after matching; for the other two a shorter match can hide no longer one.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"

BLOCK = 256  # matches whose places are added up at once
WINDOW = 20
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Least entropy in bits of a window, by the characters of the stretch (signs aside): the expected entropy of 20 random
#: draws (3.36 of 16 characters, 3.59 of 22, 3.79 of 32, 4.03 of 62) less a margin of 0.37 to 0.44, under which 1 to 2 % of them fall.
CLASSES = (
    (r"^([0-9a-f/_=-]+|[0-9A-F/_=-]+)$", 2.93),
    (r"^[0-9a-fA-F/_=-]+$", 3.15),
    (r"^([0-9a-z/_=-]+|[0-9A-Z/_=-]+)$", 3.38),
)
OTHER_BITS = 3.66
#: Parts of a candidate, between its signs, that are no secrets: numbers, words in one case or in humps (with a short number),
#: groups of hex digits as identifiers have them, fill-ins, and keys of documentation.
PARTS = (
    "[0-9]+", "[A-Z]{2,}[0-9]{0,4}", "[A-Z]?[a-z]{2,}(?:[A-Z][a-z]+){0,40}[0-9]{0,4}",
    "[0-9a-f]{4}", "[0-9a-f]{8}", "[0-9a-f]{12}", "[xX]{4,}", "[A-Za-z0-9+]{0,40}EXAMPLE(?:KEY)?",
)
#: The same with the signs beside them, for splitting; letters of a hump are taken for good, so no text is gone over again and again.
ALLOWED = f"[/_=-]*+(?<![A-Za-z0-9+])(?:{'|'.join(PARTS)})(?![A-Za-z0-9+])[/_=-]*+".replace("[a-z]{2,}", "[a-z]{2,}+").replace("[a-z]+", "[a-z]++")


def _text(value: str) -> str:
    """A SQL literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _found(text: str, pattern: str, keep: str, group: int = 0, gaps: bool = False) -> str:
    """SQL for an array of (s, e, x): start and end in code points and group `group` of the matches for which `keep` holds.

    With `gaps` it is what stands between the matches. Splitting at the pattern gives the gaps
    between its matches, so running lengths give the places: first within runs of BLOCK matches, then over the runs, as
    an array that grows by one costs the square of its length.
    """
    p = _text(pattern)
    spans = "array<struct<s:int,e:int,x:string>>"
    place = "a.at + m.g AS s, a.at + m.g + m.h AS e"
    value, some = "x", "m.h IS NOT NULL"
    if gaps:
        place, value, some = "a.at AS s, a.at + m.g AS e", "m.g", "true"
    return f"""
        CASE WHEN {text} RLIKE {p} OR {str(gaps).lower()} THEN flatten(aggregate(
            transform(
                transform(
                    array(zip_with(zip_with(split({text}, {p}, -1), regexp_extract_all({text}, {p}, 0), (g, h) -> struct(g, h)),
                                   regexp_extract_all({text}, {p}, {group}), (m, x) -> struct(length(m.g) AS g, length(m.h) AS h, {value} AS x))),
                    all -> transform(sequence(0, (size(all) - 1) div {BLOCK}), b -> slice(all, b * {BLOCK} + 1, {BLOCK})))[0],
                block -> aggregate(
                    block,
                    struct(0 AS at, CAST(array() AS {spans}) AS out),
                    (a, m) -> struct(
                        a.at + m.g + coalesce(m.h, 0) AS at,
                        CASE WHEN {some} AND {keep}
                             THEN concat(a.out, array(struct({place}, m.x AS x)))
                             ELSE a.out END AS out))),
            struct(0 AS at, CAST(array() AS array<{spans}>) AS out),
            (a, k) -> struct(
                a.at + k.at AS at,
                concat(a.out, array(transform(k.out, o -> struct(o.s + a.at AS s, o.e + a.at AS e, o.x AS x)))) AS out),
            a -> a.out))
        ELSE CAST(array() AS {spans}) END"""


def _stretches(candidates: str) -> str:
    """SQL for what is left of the candidates without the parts that the allow-list names, where long enough for a window."""
    inner = _found("k.x", ALLOWED, f"m.g >= {WINDOW}", gaps=True)
    return f"flatten(transform({candidates}, k -> transform({inner}, y -> struct(k.s + y.s AS s, k.s + y.e AS e, y.x AS x))))"


def _entropy_spans(stretches: str) -> str:
    """SQL for the part of each stretch from the first to the last window above the threshold of its class.

    One step takes the character that enters (i) and the one that leaves (o, -1 at first); `n` has the counts of the
    window, a letter each ('A' for none), so that a step changes two of them in place. `sum` is the sum of n log2 n, and the
    entropy is log2(WINDOW) - sum / WINDOW.
    """
    w = WINDOW
    term = "array(0D, " + ", ".join(f"{k}D * log2({k}D)" for k in range(1, w + 1)) + ")"
    most = f"{w}D * (log2({w}D) - k.least)"  # a window counts if its sum is at most this
    least = " ".join(f"WHEN k.x RLIKE '{p}' THEN {bits}D" for p, bits in CLASSES)
    count = lambda n, at: f"(ascii(substr({n}, {at} + 1, 1)) - 65)"
    put = lambda n, at, value: f"overlay({n} PLACING char(65 + {value}) FROM {at} + 1 FOR 1)"
    return f"""
        filter(transform(
            transform({stretches}, k -> struct(k.s AS s,
                transform(split(k.x, ''), c -> instr('{ALPHABET}', c) - 1) AS c,
                CASE {least} ELSE {OTHER_BITS}D END AS least)),
            k -> aggregate(
                zip_with(k.c, slice(concat(array_repeat(-1, {w}), k.c), 1, size(k.c)), (i, o) -> struct(i, o)),
                named_struct('n', repeat('A', {len(ALPHABET)}), 'sum', 0D, 't', 0, 'first', -1, 'last', -1),
                (a, x) -> transform(
                    array(named_struct('n', {put("a.n", "x.i", count("a.n", "x.i") + " + 1")}, 'had', {count("a.n", "x.i")})),
                    b -> named_struct(
                        'n', if(x.o < 0, b.n, {put("b.n", "x.o", count("b.n", "x.o") + " - 1")}),
                        'sum', if(x.i = x.o, a.sum, a.sum + get({term}, b.had + 1) - get({term}, b.had)
                            - if(x.o < 0, 0D, get({term}, {count("b.n", "x.o")}) - get({term}, {count("b.n", "x.o")} - 1))),
                        't', a.t + 1,
                        'first', if(a.t >= {w} AND a.first < 0 AND a.sum <= {most}, a.t - {w}, a.first),
                        'last', if(a.t >= {w} AND a.sum <= {most}, a.t, a.last)))[0],
                a -> struct(
                    k.s + if(a.first < 0, a.t - {w}, a.first) AS s,
                    k.s + if(a.sum <= {most}, a.t, a.last) AS e))),
            x -> x.s < x.e AND x.e - x.s >= {w})"""


def _joined(kinds: dict[str, str]) -> str:
    """SQL for kind:start:end of the named arrays, by start and then kind as listed, comma-joined."""
    parts = [
        f"transform({column}, x -> struct(x.s AS s, {nth} AS k, concat('{kind}:', x.s, ':', x.e) AS t))"
        for nth, (kind, column) in enumerate(kinds.items())
    ]
    return f"array_join(transform(array_sort(concat({', '.join(parts)})), x -> x.t), ',')"


def find_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with n_assign, n_access, n_hex (long), `base` and `spans` (kind:start:end, comma-joined).

    Places are code points, ends exclusive. `base` holds the three fixed kinds, `spans` also `entropy`: windows
    of high entropy in candidates (runs of at least 20 letters, digits and `+/_=-`), less the parts between signs that the
    allow-list names. A null or empty text has no spans, one of any length is searched whole, and time grows with length.
    Rows are judged one by one, so repeated rows, ids and nulls elsewhere do not matter. Input columns named
    like the five new ones are replaced; other columns stay.
    """
    names = ("n_assign", "n_access", "n_hex", "base", "spans")
    kept = [c for c in docs.columns if c.lower() not in names]
    t = "__text"
    found = docs.select(*kept, F.coalesce(F.col(text), F.lit("")).alias(t)).select(
        *kept,
        F.expr(_found(t, ASSIGN, "length(m.x) >= 6", 2)).alias("__assign"),
        F.expr(_found(t, ACCESS, "true")).alias("__access"),
        F.expr(_found(t, HEX, "true")).alias("__hex"),
        F.expr(_found(t, CANDIDATE, "true")).alias("__candidate"),
    )
    found = found.withColumn("__stretch", F.expr(f"CASE WHEN size(__candidate) > 0 THEN {_stretches('__candidate')} ELSE __candidate END"))
    kinds = {"assign": "__assign", "access": "__access", "hex": "__hex"}
    none = F.expr("CAST(array() AS array<struct<s:int,e:int>>)")
    entropy = F.when(F.size("__stretch") > 0, F.expr(_entropy_spans("__stretch"))).otherwise(none)
    spans = found.withColumn("__entropy", entropy)
    return spans.select(
        *kept,
        *[F.size(c).cast("long").alias(f"n_{kind}") for kind, c in kinds.items()],
        F.expr(_joined(kinds)).alias("base"),
        F.expr(_joined(kinds | {"entropy": "__entropy"})).alias("spans"),
    )


def _oracle() -> str:
    def either(word: str) -> str:
        """The word with letters in either case spelled out: another engine folds more than A-Z."""
        return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)

    words = "|".join(map(either, ("password", "passwd", "secret", "token", "api_?key")))
    assign = rf"({words})[\"'']?\x20*[:=]\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"
    least = " ".join(f"WHEN regexp_matches(x, '{p}') THEN {bits}" for p, bits in CLASSES)

    def kind(name: str, nth: int, pattern: str, group: int, keep: str) -> str:
        return f"""
        {name} AS (
            SELECT id, '{name}' AS kind, {nth} AS nth, x, upto - length(m) AS s, upto AS e FROM (
                SELECT id, m, x, sum(length(g) + length(m)) OVER (PARTITION BY id ORDER BY i ROWS UNBOUNDED PRECEDING) AS upto FROM (
                    SELECT id, unnest(regexp_split_to_array(text, '{pattern}')[:-2]) AS g, unnest(regexp_extract_all(text, '{pattern}', 0)) AS m,
                           unnest(regexp_extract_all(text, '{pattern}', {group})) AS x,
                           unnest(range(len(regexp_extract_all(text, '{pattern}', 0)))) AS i
                    FROM docs WHERE regexp_matches(text, '{pattern}')))
            WHERE {keep}
        )"""

    return f"""
    WITH docs AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text FROM documents),
    {kind("assign", 0, assign, 2, "length(x) >= 6")},
    {kind("access", 1, ACCESS, 0, "true")},
    {kind("hex", 2, HEX, 0, "true")},
    {kind("candidate", 3, CANDIDATE, 0, "true")},
    pieces AS (
        SELECT id, s AS origin, unnest(regexp_extract_all(x, '[^/_=-]+|[/_=-]')) AS piece,
               unnest(range(len(regexp_extract_all(x, '[^/_=-]+|[/_=-]')))) AS i FROM candidate
    ), placed AS (
        SELECT *, regexp_full_match(piece, '{"|".join(PARTS)}') AS named,
               sum(length(piece)) OVER (PARTITION BY id, origin ORDER BY i ROWS UNBOUNDED PRECEDING) - length(piece) AS ahead FROM pieces
    ), runs AS (
        SELECT *, sum(named::INT) OVER (PARTITION BY id, origin ORDER BY i ROWS UNBOUNDED PRECEDING) AS run,
               sum(named::INT) OVER (PARTITION BY id, origin) AS last_run FROM placed
    ), joined_runs AS (
        SELECT id, origin + min(ahead) AS s, string_agg(piece, '' ORDER BY i) AS x, run, last_run
        FROM runs WHERE NOT named GROUP BY id, origin, run, last_run
    ), right_cut AS (SELECT id, s, run, CASE WHEN run < last_run THEN rtrim(x, '/_=-') ELSE x END AS x FROM joined_runs
    ), stretches AS (
        SELECT id, s + CASE WHEN run > 0 THEN length(x) - length(ltrim(x, '/_=-')) ELSE 0 END AS s,
               CASE WHEN run > 0 THEN ltrim(x, '/_=-') ELSE x END AS x FROM right_cut
    ), windows AS (
        SELECT id, s, x, unnest(range(length(x) - {WINDOW - 1})) AS i FROM stretches WHERE length(x) >= {WINDOW}
    ), entropy AS (
        SELECT id, 'entropy' AS kind, 3 AS nth, '' AS x, s + min(i) AS s, s + max(i) + {WINDOW} AS e FROM windows
        WHERE list_entropy(string_split(substr(x, i::INT + 1, {WINDOW}), ''))
              >= CASE {least} ELSE {OTHER_BITS} END
        GROUP BY id, windows.s, windows.x
    ), spans AS (
        SELECT * FROM assign UNION ALL SELECT * FROM access UNION ALL SELECT * FROM hex UNION ALL SELECT * FROM entropy
    ), joined AS (
        SELECT id, count(*) FILTER (nth = 0) AS a, count(*) FILTER (nth = 1) AS b, count(*) FILTER (nth = 2) AS c,
               string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, nth) FILTER (nth < 3) AS base,
               string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, nth) AS spans
        FROM spans GROUP BY id
    )
    SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex,
           sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM docs LEFT JOIN joined USING (id)
    """


@query("op10_secrets", _oracle())
def op10_secrets(spark, sf_dir):
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")
