"""Technology fingerprints of projects, and asset lists matched against them."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from riskloom.functions import paths, texts
from riskloom.functions.blocks import BLOCK_CHARS, blocks_of
from riskloom.functions.durable import durable
from riskloom.functions.ranking import top_n

# Label -> patterns; platform label -> kind.
PLATFORMS = {"Strapi": ["strapi", "users-permissions"], "Directus": ["directus"], "Payload CMS": ["payloadcms", r"\bpayload\b"],
             "Keystone": ["keystone"], "Ghost": [r"\bghost\b"], "Wagtail": ["wagtail"],
             "WordPress": ["wordpress", "wp-content", "wp-admin"], "Joomla": ["joomla"], "Drupal": ["drupal"]}
PLATFORM_KINDS = {"Strapi": "headless", "Directus": "headless", "Payload CMS": "headless", "Keystone": "headless",
                  "Ghost": "blog", "Wagtail": "enterprise", "WordPress": "blog", "Joomla": "enterprise", "Drupal": "enterprise"}
TECHNOLOGIES = {"Next.js": [r"\bnext\b", "next/config"], "NestJS": [r"\bnestjs\b", "@nestjs/"], "Express": [r"\bexpress\b"],
                "Koa": [r"\bkoa\b"], "React": [r"\breact\b"], "Vue": [r"\bvue\b"], "Laravel": [r"\blaravel\b"],
                "Django": [r"\bdjango\b"], "Spring": ["spring-boot", r"\bspring\b"], "GraphQL": [r"\bgraphql\b"],
                "MySQL": [r"\bmysql\b"], "PostgreSQL": ["postgres", r"\bpg\b"], "Redis": [r"\bredis\b"],
                "S3/Object Storage": [r"\bs3\b", "minio", "r2"]}
LANGUAGES = {"JavaScript / TypeScript": ["ts", "tsx", "js", "jsx"], "PHP": ["php"], "Python": ["py"], "Java": ["java"],
             "C#": ["cs"], "Ruby": ["rb"], "Go": ["go"]}


def path_hint(path: Column) -> Column:
    return F.concat(F.lit("/"), F.substring_index(F.regexp_replace(F.regexp_replace(path, "^packages/", ""), "^src/", ""), "/", 3))


def _labels(flags: dict[str, str]) -> Column:
    return F.array_compact(F.array(*[F.when(F.col(c), F.lit(label)) for label, c in flags.items()]))


def fingerprint(files: DataFrame, hints_per_project: int | None = None) -> DataFrame:
    """Per project: platforms, their kinds, technologies, languages, and admin and API path hints (the first few, if asked).

    Signature tests run per file and are combined with bool_or before the shuffle.
    """
    both = F.concat(F.col("path"), F.lit("\n"), F.col("content"))
    ext = paths.extension(F.col("path"))
    flags, cols = {"p": {}, "t": {}, "l": {}}, []
    for group, table in (("p", PLATFORMS), ("t", TECHNOLOGIES)):
        for i, (label, pats) in enumerate(table.items()):
            flags[group][label] = f"{group}{i}"
            cols.append(texts.any_match(both, pats).alias(f"{group}{i}"))
    for i, (label, exts) in enumerate(LANGUAGES.items()):
        flags["l"][label] = f"l{i}"
        cols.append(ext.isin(exts).alias(f"l{i}"))
    names = [c for g in flags.values() for c in g.values()]
    per = files.select("project", *cols).groupBy("project").agg(
        F.count("*").alias("file_count"), *[F.bool_or(c).alias(c) for c in names])
    kinds = F.array_distinct(F.transform(F.col("platforms"), lambda p: F.element_at(
        F.create_map(*[F.lit(x) for kv in PLATFORM_KINDS.items() for x in kv]), p)))
    out = per.select("project", "file_count", _labels(flags["p"]).alias("platforms"), _labels(flags["t"]).alias("technologies"),
                     _labels(flags["l"]).alias("languages")).withColumn("platform_kinds", kinds)
    for name, pattern in (("admin_paths", "(admin|dashboard|backoffice|panel)"), ("api_paths", "(api|graphql|content-api|rest)")):
        hints = files.where(F.lower("path").rlike(pattern)).select("project", path_hint(F.col("path")).alias("hint")).distinct()
        few = top_n(hints, hints_per_project, [F.col("hint")], by=["project"]).groupBy("project").agg(
            F.sort_array(F.collect_list("hint")).alias(name))
        out = out.join(few, "project", "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    return out


def asset_tokens(fingerprints: DataFrame) -> DataFrame:
    """(project, token, ord): what an asset line is searched for, in report order."""
    tokens = F.concat("platforms", "technologies", "admin_paths", "api_paths")
    return fingerprints.select("project", F.posexplode(F.transform(tokens, F.lower)).alias("ord", "token")).where("token <> ''")


def _token_finder(sent):
    """Rows (asset, token) for the tokens that a lower-cased asset holds."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = ahocorasick.Automaton()
        for token in sent.value:
            words.add_word(token, token)
        words.make_automaton()
        for b in batches:
            hits = [sorted({t for _, t in words.iter(low)}) if len(words) else [] for low in b.column(1).to_pylist()]
            at = [i for i, h in enumerate(hits) for _ in h]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array([t for h in hits for t in h], pa.string())],
                                             names=["asset", "token"])

    return run


def match_assets(assets: DataFrame, fingerprints: DataFrame, per_asset: int | None = None, limit: int | None = None,
                 text: str = "asset") -> DataFrame:
    """Asset lines that hold a token of a project, with the tokens hit, in report order; per_asset and limit shorten the report if asked.

    Each distinct asset is read once per block of distinct tokens, by one automaton that finds all tokens of the block in a
    single pass. Only true hits leave a task; nothing is joined on pieces of text.
    """
    tokens = durable(asset_tokens(fingerprints))
    a = assets.select(F.trim(text).alias("asset")).where("asset <> ''").distinct().select("asset", F.lower("asset").alias("low"))
    found = None
    for block in blocks_of(tokens.select("token").distinct(), "token", BLOCK_CHARS):
        part = a.mapInArrow(_token_finder(assets.sparkSession.sparkContext.broadcast([t for (t,) in block])), "asset string, token string")
        found = part if found is None else found.unionByName(part)
    hits = found.join(tokens, "token")
    few = top_n(hits, per_asset, [F.col("ord")], by=["project", "asset"])
    out = few.groupBy("project", "asset").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("ord", "token"))), lambda x: x["token"]).alias("hit_tokens"))
    return out if limit is None else top_n(out, limit, [F.col("asset")], by=["project"])
