"""A corpus from dialogues: cleaned, masked, deduplicated, split, augmented in the training part alone, and described."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import text as tx
from tallyloom.operators import corpus
from tallyloom.sources.shared import written

SUFFIX = "-asr"
#: A whole number, perhaps in groups of three digits.
NUMERAL = re.compile(r"\d{1,3}(?:[  ]\d{3})+|\d+")
#: Number words of Russian and Kazakh by place: fixed values.
RU_ONES = "ноль один два три четыре пять шесть семь восемь девять десять одиннадцать двенадцать тринадцать четырнадцать пятнадцать шестнадцать семнадцать восемнадцать девятнадцать".split()
RU_TENS = "двадцать тридцать сорок пятьдесят шестьдесят семьдесят восемьдесят девяносто".split()
RU_HUNDREDS = "сто двести триста четыреста пятьсот шестьсот семьсот восемьсот девятьсот".split()
RU_POWERS = (("тысяча", "тысячи", "тысяч"), ("миллион", "миллиона", "миллионов"), ("миллиард", "миллиарда", "миллиардов"), ("триллион", "триллиона", "триллионов"))
KK_ONES = "нөл бір екі үш төрт бес алты жеті сегіз тоғыз".split()
KK_TENS = "он жиырма отыз қырық елу алпыс жетпіс сексен тоқсан".split()
KK_POWERS = ("мың", "миллион", "миллиард", "триллион")


def _three(n: int, language: str, feminine: bool = False) -> list[str]:
    """The words of a number below 1000; none for 0."""
    hundreds, rest = divmod(n, 100)
    if language == "kk":
        tens, ones = divmod(rest, 10)
        return ([*([KK_ONES[hundreds]] if hundreds > 1 else []), "жүз"] if hundreds else []) + ([KK_TENS[tens - 1]] if tens else []) + ([KK_ONES[ones]] if ones else [])
    said = [RU_HUNDREDS[hundreds - 1]] if hundreds else []
    if rest >= 20:
        said.append(RU_TENS[rest // 10 - 2])
        rest %= 10
    if rest:
        said.append({1: "одна", 2: "две"}.get(rest, RU_ONES[rest]) if feminine else RU_ONES[rest])
    return said


def spelt(digits: str, language: str = "ru") -> str:
    """A whole number in words; digit by digit where it is too large to have a name here."""
    n = int(digits)
    powers = KK_POWERS if language == "kk" else RU_POWERS
    ones = KK_ONES if language == "kk" else RU_ONES
    if n == 0 or n >= 1000 ** (len(powers) + 1):
        return " ".join(ones[int(d)] for d in (digits if n else "0"))
    said: list[str] = []
    for power in range(len(powers), -1, -1):
        part = n // 1000**power % 1000
        if not part:
            continue
        words = _three(part, language, feminine=power == 1)
        if power and language == "kk":
            words = words if part > 1 or said or power > 1 else []
            words = [*words, powers[power - 1]]
        elif power:
            form = 2 if part % 100 in range(11, 15) else 0 if part % 10 == 1 else 1 if part % 10 in (2, 3, 4) else 2
            words = [*([] if part == 1 and power == 1 and not said else words), powers[power - 1][form]]
        said += words
    return " ".join(said)


def styled(text: Column, language: Column, drop_latin: bool = False) -> Column:
    """A text as a recogniser would put it: numerals in words, everything but letters and digits as spaces, lower case; Latin words go if drop_latin. Only texts with digits leave the JVM."""

    @F.pandas_udf("string")
    def spell(texts: pd.Series, languages: pd.Series) -> pd.Series:
        said = []
        for t, lang in zip(texts, languages, strict=True):
            lang = "kk" if lang == "kk" else "ru"
            said.append(None if t is None else NUMERAL.sub(lambda m: f" {spelt(''.join(c for c in m[0] if c.isdigit()), lang)} ", t))  # noqa: B023
        return pd.Series(said, dtype=object)

    worded = F.coalesce(spell(F.when(text.rlike(r"[0-9]"), text), F.coalesce(language, F.lit("ru"))), text)
    worded = F.regexp_replace(worded, "[A-Za-z]+", " ") if drop_latin else worded
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(worded, r"(?U)[^\w]+|_+", " "), r"\s+", " ")))


def styled_copies(rows: DataFrame, share: float, seed: int, row_id: str = "id", text: str = "text", language: str = "lang", style: Callable[[Column, Column], Column] = styled) -> DataFrame:
    """Copies (id-asr) of the rows whose hash with the seed is below share, as styled() puts them; those that style to nothing are left out."""
    chosen = rows.where(tx.fold_share(F.concat(F.lit(f"{seed}:"), F.col(row_id).cast("string")), share))
    put = chosen.withColumn(text, style(F.col(text), F.col(language))).withColumn(row_id, F.concat(F.col(row_id).cast("string"), F.lit(SUFFIX)))
    return put.where(F.col(text) != "")


def generated_split(row_id: Column, seed: int = 0, val: float = 0.15) -> Column:
    """train or val of generated rows, never test."""
    return F.when(tx.unit_interval(F.concat(F.lit(f"gen:{seed}:"), row_id.cast("string"))) < val, "val").otherwise("train")


def built(rows: DataFrame, generated: DataFrame | None = None, extra: DataFrame | None = None, seed: int = 0, share: float = 0.25, mask: Callable[[Column], Column] | None = None, style: Callable[[Column, Column], Column] = styled) -> DataFrame:
    """id, text, lang, split, origin of a whole corpus. rows, generated and extra: id (string), text, lang.

    Texts are cleaned (corrupted ones go), masked, and kept once by their normal form, in the order of id within an origin; rows are split by hash, generated ones into train and val alone, extra ones
    are for training alone, and a share of the training rows has a styled copy there. A text that an earlier step put into train or val isn't put there again.
    """

    def first(part: DataFrame, origin: str) -> DataFrame:
        hashed = written(part.select("id", "text", "lang", tx.text_hash(F.coalesce("text", F.lit(""))).alias("_h")), "corpus-texts")
        return corpus.keep_first(hashed, "id", own=F.col("_h")).withColumn("origin", F.lit(origin))

    def ready(part: DataFrame, origin: str) -> DataFrame:
        cleaned = part.where(~tx.corrupted(F.col("text"))).withColumn("text", tx.clean(F.col("text")))
        return first(cleaned.withColumn("text", mask(F.col("text"))) if mask else cleaned, origin)

    whole = ready(rows, "real").withColumn("split", tx.assign_split(F.col("id"), seed))
    steps = [] if generated is None else [ready(generated, "generated").withColumn("split", generated_split(F.col("id"), seed))]
    steps += [] if extra is None else [ready(extra, "extra").withColumn("split", F.lit("train"))]
    for step in steps:
        whole = whole.unionByName(_unseen(step, whole))
    whole = written(whole, "corpus")
    made = styled_copies(whole.where("split = 'train'"), share, seed, style=style)
    made = first(made.withColumn("text", mask(F.col("text"))) if mask else made, "styled").withColumn("split", F.lit("train"))
    return whole.unionByName(_unseen(made, whole)).drop("_h")


def _unseen(rows: DataFrame, whole: DataFrame) -> DataFrame:
    """rows whose normalised text (its hash: _h) their own split of whole doesn't have."""
    return rows.join(whole.select("split", "_h").dropDuplicates(), ["split", "_h"], "left_anti")


def provenance(rows: DataFrame, generator: str, positive: Column) -> DataFrame:
    """split, generator, n, positives, share: how likely a row of each generator is positive."""
    counted = rows.groupBy("split", generator).agg(F.count(F.lit(1)).alias("n"), F.sum(positive.cast("int")).alias("positives"))
    return counted.withColumn("share", F.round(F.col("positives") / F.col("n"), 4))


def base_id(row_id: Column) -> Column:
    """A copy's source."""
    return F.regexp_replace(row_id, f"{SUFFIX}$", "")


def attempts(rows: DataFrame, groups: list[str], slot: str, reason: str) -> DataFrame:
    """groups, attempts, accepted (no reason), slots (different accepted ones) and rejected, the share of attempts."""
    ok = F.col(reason).isNull()
    counted = rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("attempts"), F.sum(ok.cast("int")).alias("accepted"), F.count_distinct(F.when(ok, F.col(slot))).alias("slots"))
    return counted.withColumn("rejected", F.round(1 - F.col("accepted") / F.col("attempts"), 3))


def verdicts(rows: DataFrame, chunk: str, row_id: str, reason: str, least: float = 0.8) -> DataFrame:
    """chunk, n, accepted, passes of rows (chunk, id, reason: null or one of several reasons of a row): a chunk passes with the share least of rows without a reason."""
    each = rows.groupBy(chunk, row_id).agg(F.max(F.col(reason).isNotNull()).alias("_bad"))
    counted = each.groupBy(chunk).agg(F.count(F.lit(1)).alias("n"), F.sum((~F.col("_bad")).cast("int")).alias("accepted"))
    return counted.withColumn("passes", F.col("accepted") / F.col("n") >= least)


def accepted(manifest: DataFrame, passed: DataFrame, rejects: DataFrame, row_id: str) -> DataFrame:
    """The rows of the manifest that passed and that no reviewer rejected."""
    return manifest.join(passed.select(row_id), row_id, "left_semi").join(rejects.select(row_id), row_id, "left_anti")


def echoes(text: Column, prompt: Column, n: int = 8) -> Column:
    """Whether n words in a row are also in the prompt, in any case."""

    def grams(t: Column) -> Column:
        words = F.filter(F.split(F.lower(t), r"\s+"), lambda w: w != "")

        def cut(ws: Column) -> Column:  # a lambda's argument is worked out once, however often it is used
            return F.when(F.size(ws) >= n, F.transform(F.sequence(F.lit(1), F.size(ws) - n + 1), lambda i: F.array_join(F.slice(ws, i, n), " "))).otherwise(F.array().cast("array<string>"))

        return F.transform(F.array(words), cut)[0]

    return F.arrays_overlap(grams(text), grams(prompt))


def turn_spans(turns: DataFrame, phrases: str, call: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """call, turn, phrase, start, end of phrases (an array) that their turn has, as offsets in the turns joined by line ends."""
    from pyspark.sql import Window

    before = F.coalesce(F.sum(F.length(text) + 1).over(Window.partitionBy(call).orderBy(turn).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = turns.withColumn("_before", before).withColumn("phrase", F.explode(phrases))
    start = F.col("_before") + F.instr(F.col(text), F.col("phrase")) - 1
    return rows.where((F.col("phrase") != "") & (F.instr(F.col(text), F.col("phrase")) > 0)).select(call, turn, "phrase", start.alias("start"), (start + F.length("phrase")).alias("end"))


def word_errors(pairs: DataFrame, truth: str, said: str, groups: list[str]) -> DataFrame:
    """groups, words, errors and rate: edits between words of pairs, as a ratio of sums."""

    @F.pandas_udf("struct<words int, errors int>")
    def edits(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        out = []
        for x, y in zip(a, b, strict=True):
            x, y = (x or "").split(), (y or "").split()
            row = list(range(len(y) + 1))
            for i, w in enumerate(x, 1):
                last, row[0] = row[0], i
                for j, v in enumerate(y, 1):
                    last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (w != v))
            out.append((len(x), row[-1]))
        return pd.DataFrame(out, columns=["words", "errors"])

    counted = pairs.withColumn("_e", edits(F.col(truth), F.col(said))).groupBy(*groups).agg(F.sum("_e.words").alias("words"), F.sum("_e.errors").alias("errors"))
    return counted.withColumn("rate", F.round(F.col("errors") / F.col("words"), 6))


def unmasked(rows: DataFrame, row_id: str, turns: str, mask: Callable[[Column], Column]) -> DataFrame:
    """id and place of the turns (an array) that masking would change; never their text."""
    each = rows.select(row_id, F.posexplode(turns).alias("place", "_t"))
    return each.where(mask(F.col("_t")) != F.col("_t")).select(row_id, "place")


def grounded(phrases: Column, masked: Column, mask: Callable[[Column], Column]) -> Column:
    """Each phrase as the masked text has it: as it is, else masked, if a letter is left of it outside of placeholders; each once, in order."""

    def seen(p: Column) -> Column:
        m = mask(p)
        bare = m
        for placeholder in tx.PLACEHOLDERS.values():
            bare = F.replace(bare, F.lit(placeholder), F.lit(""))
        return F.when(F.trim(p) == "", None).when(F.contains(masked, p), p).when(F.contains(masked, m) & bare.rlike(r"\p{L}"), m)

    return F.array_distinct(F.filter(F.transform(phrases, seen), lambda p: p.isNotNull()))


def lexicon_hash(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One hash of a small table that doesn't depend on its order."""
    return rows.agg(F.sha2(F.array_join(F.array_sort(F.collect_set(F.concat_ws("\x1f", *columns))), "\n"), 256).alias("hash"))


def run_states(plan: DataFrame, done: DataFrame, chunk: str) -> DataFrame:
    """chunk, state of plan (chunk, wanted) by done (chunk, n, passes: null before its check)."""
    rows = plan.join(done, chunk, "left")
    state = F.when(F.coalesce("n", F.lit(0)) == 0, "missing").when(F.col("n") < F.col("wanted"), "incomplete").when(F.col("passes").isNull(), "written").when(F.col("passes"), "qc_pass").otherwise("qc_fail")
    return rows.select(chunk, state.alias("state"))


def grid_gaps(rows: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """For each cell that is planned or has rows: n rows and its state, filled, missing or unplanned. A null key equals none, so a null cell is missing and its rows are unplanned."""
    held = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    planned = cells.select(*keys).dropDuplicates().withColumn("_planned", F.lit(True))
    state = F.when(F.col("_planned").isNull(), "unplanned").when(F.col("n").isNull(), "missing").otherwise("filled")
    return planned.join(held, keys, "full").select(*keys, F.coalesce("n", F.lit(0)).alias("n"), state.alias("state"))


def cue_free(rows: DataFrame, groups: list[str], positive: Column, found: Column) -> DataFrame:
    """positives of each group, those of them without a cue (found: the cues of a row), and their share; groups without positives are left out."""
    none = F.coalesce(F.size(found), F.lit(0)) <= 0
    counted = rows.where(positive).groupBy(*groups).agg(F.count(F.lit(1)).alias("positives"), F.sum(F.when(none, 1).otherwise(0)).alias("cue_free"))
    return counted.withColumn("share", F.round(F.col("cue_free") / F.col("positives"), 6))


def review_list(rows: DataFrame, checks: list[tuple[str, Column]]) -> DataFrame:
    """Rows that somebody has to look at, with their reasons, sorted: the names of the checks that are true of them. A check that is null isn't."""
    named = F.array(*(F.when(check, F.lit(name)) for name, check in checks))
    reasons = F.array_sort(F.array_distinct(F.filter(named, lambda r: r.isNotNull())))
    return rows.withColumn("reasons", reasons).where(F.size("reasons") > 0)


def table_lines(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Each row as a line of a Markdown table (line): nulls are empty, bars are escaped, line ends become spaces."""
    cells = [F.regexp_replace(F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"\|", r"\\|"), r"[\r\n]+", " ") for c in columns]
    return rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))
