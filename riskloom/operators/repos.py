"""Repository metadata: one schema, scores, traits, and which files to take."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from riskloom.functions import paths
from riskloom.functions.ranking import first_per, top_n
from riskloom.functions.severity import or_default, round_half_up

# Words that mark platforms, their kinds and industries.
PLATFORM_WORDS = ["cms", "headless", "content management", "content platform", "blog", "admin panel", "publishing", "webcms",
                  "digital experience", "editorial"]
KIND_WORDS = {"headless": ["headless", "api-first", "content api", "content-api"],
              "blog": ["blog", "publishing", "editorial", "news"],
              "ecommerce": ["ecommerce", "e-commerce", "shop", "storefront", "shopping"],
              "enterprise": ["enterprise", "digital experience", "portal", "dxp"],
              "education": ["lms", "education", "learning", "course"], "flatfile": ["flat-file", "flat file", "markdown"]}
INDUSTRY_WORDS = {"education": ["education", "learning", "course", "student", "campus"],
                  "ecommerce": ["ecommerce", "store", "shop", "product", "catalog"],
                  "media": ["media", "editorial", "news", "publishing", "magazine"],
                  "enterprise": ["enterprise", "portal", "workflow", "business"],
                  "government": ["government", "public sector", "civic", "municipal"],
                  "community": ["forum", "community", "member", "social"]}
REVIEWABLE = ["ts", "tsx", "js", "jsx", "mjs", "cjs", "json", "yml", "yaml", "php", "py", "go", "java", "rb", "xml", "graphql",
              "gql"]
IGNORED = ["node_modules/", "dist/", "build/", "coverage/", ".next/", ".nuxt/", "vendor/", "fixtures/", "__snapshots__/",
           "storybook-static/", "public/build/"]
PATH_WORDS = ["auth", "login", "session", "permission", "policy", "upload", "storage", "admin", "config", "controller", "route",
              "api", "middleware", "access", "rbac", "role", "plugin", "bootstrap", "seed", "collection", "schema"]
MIRROR_WORDS = ["auth", "login", "session", "permission", "policy", "upload", "storage", "admin", "config", "controller",
                "route", "api", "middleware", "access", "rbac", "role", "plugin", "graphql", "bootstrap", "seed", "schema",
                "security"]


def _field(df: DataFrame, *names, cast: str = "string") -> Column:
    """The first filled column of several spellings; nested names are looked up in their struct."""
    found = []
    for n in names:
        top = n.split(".")[0]
        if top in df.columns and ("." not in n or n.split(".", 1)[1] in df.schema[top].dataType.fieldNames()):
            c = F.col(n).cast(cast)
            found.append(F.nullif(c, F.lit("")) if cast == "string" else c)
    return F.coalesce(*found) if found else F.lit(None).cast(cast)


def normalize_projects(df: DataFrame, as_of: Column | None = None) -> DataFrame:
    """One spelling for both naming styles; missing fields take their defaults."""
    now = (as_of if as_of is not None else F.current_timestamp()).cast("timestamp")
    topics = F.coalesce(F.col("topics"), F.array().cast("array<string>")) if "topics" in df.columns else F.array().cast("array<string>")
    stars, forks = _field(df, "stargazers_count", "adoptionSignals.stars", cast="long"), _field(df, "forks_count", "adoptionSignals.forks", cast="long")
    return df.select(
        _field(df, "id").alias("id"), _field(df, "full_name", "name").alias("full_name"), _field(df, "name").alias("name"),
        F.coalesce(_field(df, "html_url", "repoUrl"), F.lit("")).alias("html_url"),
        F.coalesce(_field(df, "description"), F.lit("")).alias("description"),
        F.coalesce(_field(df, "language"), F.lit("Unknown")).alias("language"), F.coalesce(stars, F.lit(0)).alias("stars"),
        F.coalesce(forks, F.lit(0)).alias("forks"),
        F.coalesce(_field(df, "updated_at", "updatedAt").try_cast("timestamp"), now).alias("updated_at"),
        F.coalesce(_field(df, "pushed_at", "pushedAt").try_cast("timestamp"), now).alias("pushed_at"),
        F.coalesce(_field(df, "default_branch", "defaultBranch"), F.lit("main")).alias("default_branch"), topics.alias("topics"))


def _text() -> Column:
    return F.lower(F.concat(F.coalesce("full_name", F.lit("")), F.lit(" "), F.coalesce("description", F.lit("")), F.lit(" "),
                            F.array_join(F.coalesce("topics", F.array().cast("array<string>")), " ")))


def _any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def repo_score(as_of: Column) -> Column:
    """Stars * 1.05 + forks * 2.15 + 2000 per platform word + 4000 / 2200 / 900 for a push within 14 / 45 / 90 days."""
    text = _text()
    words = reduce(lambda a, b: a + b, [F.when(text.contains(w), 2000).otherwise(0) for w in PLATFORM_WORDS])
    when = F.coalesce("pushed_at", "updated_at")
    days = (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(when.cast("timestamp"))) / F.lit(86400000000.0)
    fresh = F.when(when.isNull(), 0).when(days <= 14, 4000).when(days <= 45, 2200).when(days <= 90, 900).otherwise(0)
    return F.col("stars") * F.lit(1.05) + F.col("forks") * F.lit(2.15) + words + fresh


def repo_traits() -> list[Column]:
    """kind, industries and tags."""
    text = _text()
    kind = F.coalesce(*[F.when(_any(text, w), F.lit(k)) for k, w in KIND_WORDS.items()], F.lit("generic"))
    found = F.array_compact(F.array(*[F.when(_any(text, w), F.lit(k)) for k, w in INDUSTRY_WORDS.items()]))
    industries = F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("general")))
    tags = F.array_distinct(F.concat(F.coalesce("topics", F.array().cast("array<string>")), F.array(kind), industries))
    return [kind.alias("kind"), industries.alias("industries"), tags.alias("tags")]


def adoption() -> Column:
    """Estimated live use: stars * 0.018 + forks * 0.28, plus 40 for a platform."""
    boost = F.when(_any(_text(), PLATFORM_WORDS), 40).otherwise(0)
    return round_half_up(F.col("stars") * F.lit(0.018) + F.col("forks") * F.lit(0.28) + boost)


def score_repos(df: DataFrame, as_of: Column) -> DataFrame:
    return df.select("*", repo_score(as_of).alias("score"), *repo_traits(), adoption().alias("estimated_use"))


def best_repos(df: DataFrame, n: int | None = None) -> DataFrame:
    """The best-scored row per full name; the list holds the top n."""
    return top_n(first_per(df, ["full_name"], [-F.col("score"), "id"]), n, [F.col("score").desc(), F.col("full_name")])


def match_project_filters(df: DataFrame, kind: str = "all", industry: str = "all", min_use: float = 0) -> DataFrame:
    out = df.where(F.coalesce("estimated_use", F.lit(0)) >= min_use)
    if kind not in ("", "all"):
        out = out.where(F.col("kind") == kind)
    if industry not in ("", "all"):
        out = out.where(F.array_contains("industries", industry))
    return out


def path_include(path: Column, words: list[str] = PATH_WORDS) -> Column:
    """Reviewable extension, a telling word, and no ignored segment."""
    low = F.lower(path)
    return ~_any(low, IGNORED) & paths.extension(low).isin(REVIEWABLE) & _any(low, words)


def mirror_path(path: Column) -> Column:
    return path_include(path, MIRROR_WORDS)


def rank_path(path: Column) -> Column:
    low = F.lower(path)
    return (F.when(low.rlike("auth|permission|policy|access|role"), 90).otherwise(0)
            + F.when(low.rlike("upload|storage|asset"), 75).otherwise(0)
            + F.when(low.rlike("admin|route|controller|middleware|graphql|api"), 60).otherwise(0)
            + F.when(low.rlike("config|bootstrap|seed|schema"), 40).otherwise(0))


def rank_mirror_path(path: Column) -> Column:
    low = F.lower(path)
    return (rank_path(path) - F.when(low.rlike("test|spec"), 30).otherwise(0)
            + F.when(low.rlike("users-permissions|authentication|graphql"), 45).otherwise(0))


def mirror_select(files: DataFrame, max_files: int, max_file_bytes: int | None = None, max_bytes: int | None = None) -> DataFrame:
    """Files to take per project: best rank first, small first, within a count and a byte budget the caller states.

    A file that would break the byte budget is passed over, a smaller one of another rank may still fit; every
    candidate counts. Inside a rank sizes ascend, so what is taken of it is always its first files: max_files of
    each rank are enough for an exact fold, and there are few ranks.
    """
    ok = files.where(mirror_path(F.col("path")) & (F.col("size") > 0))
    ok = ok if max_file_bytes is None else ok.where(F.col("size") <= max_file_bytes)
    max_bytes = 2 ** 63 - 1 if max_bytes is None else max_bytes
    ranked = ok.select("project", "path", "size", rank_mirror_path(F.col("path")).alias("rank"))
    best = top_n(ranked, max_files, [F.col("size"), F.col("path")], by=["project", "rank"])
    listed = best.groupBy("project").agg(F.sort_array(F.collect_list(F.struct(
        (-F.col("rank")).alias("neg_rank"), "size", "path"))).alias("c"))
    start = F.struct(F.lit(0).cast("long").alias("bytes"), F.array().cast("array<int>").alias("taken"))

    def take(acc, i):
        size = F.element_at("c", i)["size"]
        full = F.size(acc["taken"]) >= max_files
        over = (F.size(acc["taken"]) > 0) & (acc["bytes"] > F.lit(max_bytes) - size)
        return F.when(full | over, acc).otherwise(F.struct(
            (acc["bytes"] + size).alias("bytes"), F.concat(acc["taken"], F.array(i)).alias("taken")))

    chosen = F.aggregate(F.sequence(F.lit(1), F.size("c")), start, take)["taken"]
    return (listed.select("project", F.posexplode(F.transform(chosen, lambda i: F.element_at("c", i))).alias("p", "f"))
            .select("project", (F.col("p") + 1).alias("ord"), F.col("f.path").alias("path"), F.col("f.size").alias("size"),
                    (-F.col("f.neg_rank")).alias("rank")))


def language_share(files: DataFrame) -> DataFrame:
    """Per project: files, bytes and the most frequent language (alphabetic among equals)."""
    per = files.withColumn("language", paths.detect_language(F.col("path"))).groupBy("project", "language").agg(
        F.count("*").alias("n"), F.sum("size").alias("bytes"))
    return per.groupBy("project").agg(
        F.sum("n").alias("files"), F.sum("bytes").alias("bytes"),
        F.min_by("language", F.struct(-F.col("n"), F.col("language"))).alias("top_language"))
