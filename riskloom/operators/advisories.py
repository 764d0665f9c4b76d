"""Dependencies in affected version ranges, for any number of advisories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from riskloom.functions import versions
from riskloom.functions.durable import durable
from riskloom.functions.ranking import first_per
from riskloom.operators.components import component_findings

SCHEMA = "rule_name string, cve string, component string, affected string, severity string, fix_version string"
#: Published advisories (name, CVE or CWE, artifacts, affected versions, severity, first version to move to).
ADVISORIES = [
    ("Log4Shell", "CVE-2021-44228", "log4j-core", "[2.0,2.14.1]", "critical", "2.17.1"),
    ("Log4j2 lookup", "CVE-2021-45046", "log4j-core", "[2.15.0]", "critical", "2.17.1"),
    ("Log4j 1.x SocketServer", "CVE-2019-17571", "log4j", "[1.2,1.3)", "critical", "2.17.1"),
    ("Fastjson autotype", "CVE-2022-25845", "fastjson", "[1.2.0,1.2.80]", "critical", "1.2.83"),
    ("Fastjson gadget", "CVE-2020-8840", "fastjson", "[1.2.0,1.2.68]", "critical", "1.2.84"),
    ("Spring4Shell", "CVE-2022-22965", "spring-beans spring-core spring-context spring-web", "[5.2.0,5.2.19],[5.3.0,5.3.17]", "critical", "5.3.18"),
    ("Struts2 OGNL", "CVE-2020-17530", "struts2-core", "[2.0.0,2.5.25]", "critical", "2.5.26"),
    ("Struts2 multipart", "CVE-2017-5638", "struts2-core", "[2.3.5,2.3.31],[2.5.0,2.5.10]", "critical", "2.5.26"),
    ("Commons Collections gadget", "CVE-2015-6420", "commons-collections", "[3.0,3.2.1]", "critical", "3.2.2"),
    ("Shiro bypass", "CVE-2020-13933", "shiro-core", "[1.0.0,1.5.3]", "critical", "1.7.1"),
    ("Shiro remember-me", "CVE-2016-4437", "shiro-core", "[1.0.0,1.2.4]", "critical", "1.7.1"),
    ("SnakeYAML", "CVE-2022-1471", "snakeyaml", "[1.0,1.32]", "critical", "2.0"),
    ("Text4Shell", "CVE-2022-42889", "commons-text", "[1.5,1.9]", "critical", "1.10.0"),
    ("ActiveMQ", "CVE-2023-46604", "activemq-client", "[5.0.0,5.18.2]", "critical", "5.18.3"),
    ("RocketMQ", "CVE-2023-33246", "rocketmq-client", "[4.0.0,5.1.0]", "critical", "5.1.1"),
    ("Actuator exposure", "CWE-200", "spring-boot-starter-actuator", "[1.0,2.0)", "high", "2.0"),
    ("Jackson databind", "CVE-2020-36518", "jackson-databind", "[2.0.0,2.12.6.1]", "high", "2.13.3"),
    ("Tomcat session", "CVE-2020-9484", "tomcat-embed-core", "[9.0.0,9.0.35]", "high", "9.0.36"),
    ("Shiro path", "CVE-2020-11989", "shiro-core", "[1.0.0,1.5.2]", "high", "1.5.3"),
    ("Shiro path 2", "CVE-2020-17510", "shiro-core", "[1.0.0,1.7.0)", "high", "1.7.1"),
    ("Shiro path 3", "CVE-2021-41303", "shiro-core", "[1.0.0,1.8.0)", "high", "1.9.0"),
    ("Shiro padding oracle", "CVE-2019-12422", "shiro-core", "[1.0.0,1.4.1]", "high", "1.7.1"),
    ("XStream", "CVE-2021-39144", "xstream", "[1.4.0,1.4.17]", "high", "1.4.18"),
    ("XStream gadget", "CVE-2021-39139", "xstream", "[1.0.0,1.4.17]", "high", "1.4.18"),
    ("XStream stack", "CVE-2022-40151", "xstream", "[1.0.0,1.4.19]", "high", "1.4.20"),
    ("Hibernate", "CVE-2020-25638", "hibernate-core", "[5.0.0,5.4.23]", "high", "5.4.24"),
    ("Commons FileUpload", "CVE-2023-24998", "commons-fileupload", "[1.0,1.5)", "high", "1.5"),
    ("Dubbo", "CVE-2020-1948", "dubbo", "[2.7.0,2.7.6]", "high", "2.7.7"),
    ("Netty smuggling", "CVE-2021-21295", "netty-codec-http", "[4.1.0,4.1.60]", "high", "4.1.61"),
    ("Commons BeanUtils", "CVE-2019-10086", "commons-beanutils", "[1.0,1.9)", "high", "1.9.4"),
    ("Elasticsearch", "CVE-2015-1427", "elasticsearch", "[1.0,1.5)", "high", "7.0"),
    ("ActiveMQ console", "CVE-2024-32114", "activemq-all", "[6.0.0,6.0.1]", "high", "6.1.2"),
    ("Nacos", "CVE-2021-29441", "nacos-client", "[1.0.0,1.4.0]", "high", "1.4.1"),
    ("Logback", "CVE-2023-6378", "logback-core", "[1.3.0,1.3.13],[1.4.0,1.4.13]", "high", "1.4.14"),
    ("CXF", "CVE-2024-28752", "cxf-core", "[3.0.0,3.6.3),[4.0.0,4.0.4)", "high", "4.0.4"),
    ("Spring Security", "CVE-2023-34035", "spring-security-core", "[5.7.0,5.7.9],[5.8.0,5.8.4],[6.0.0,6.0.3]", "high", "6.0.5"),
    ("Solr", "CVE-2024-45216", "solr-core", "[6.0.0,9.6.1]", "high", "9.7.0"),
    ("Spring Cloud Function", "CVE-2022-22963", "spring-cloud-function-context", "[3.0.0,3.2.2]", "medium", "3.2.3"),
    ("Tomcat leak", "CVE-2021-25122", "tomcat-embed-core", "[8.5.0,8.5.63]", "medium", "8.5.64"),
    ("MyBatis", "CWE-89", "mybatis", "[3.0.0,3.5.5]", "medium", "3.5.6"),
    ("FreeMarker", "CVE-2021-32836", "freemarker", "[2.3.0,2.3.30)", "medium", "2.3.31"),
    ("Thymeleaf", "CVE-2021-43466", "thymeleaf-spring5", "[3.0.0,3.0.11]", "medium", "3.0.13"),
    ("Guava temp dir", "CVE-2020-8908", "guava", "[10.0,30.0)", "medium", "30.0"),
    ("Gson", "CVE-2022-25647", "gson", "[2.0.0,2.8.8]", "medium", "2.8.9"),
    ("MySQL Connector", "CVE-2023-22102", "mysql-connector-java", "[8.0.0,8.0.34]", "medium", "8.2.0"),
    ("PostgreSQL JDBC", "CVE-2024-1597", "postgresql", "[42.0.0,42.7.1]", "medium", "42.7.2"),
    ("H2 console", "CVE-2022-23221", "h2", "[1.0.0,2.0.206]", "medium", "2.1.210"),
    ("Hutool", "CVE-2023-33695", "hutool-all", "[5.0.0,5.8.15]", "medium", "5.8.16"),
    ("Commons Compress", "CVE-2024-25710", "commons-compress", "[1.3,1.25]", "medium", "1.26.0"),
    ("Bouncy Castle", "CVE-2024-30171", "bcprov-jdk15on bcprov-jdk18on", "[1.0,1.73]", "medium", "1.78"),
    ("Avro", "CVE-2024-47561", "avro", "[1.0.0,1.11.3]", "medium", "1.11.4"),
    ("Guava, old", "CWE-1104", "guava", "[10.0,25.0)", "low", "25.0"),
    ("SLF4J, old", "CWE-1104", "slf4j-api", "[1.0,1.7)", "low", "1.7.30"),
    ("OkHttp certificates", "CWE-295", "okhttp", "[3.0.0,3.12.0]", "low", "4.0"),
]
#: Matched versions are sent to every task up to this number; beyond it they are shuffled to the dependencies.
BROADCAST_ROWS = 100_000


def built_in(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ADVISORIES, SCHEMA)


def read_advisories(spark: SparkSession, path: str) -> DataFrame:
    """Advisories from JSON lines or Parquet with the columns of SCHEMA; `component` may name several artifacts, parted by spaces."""
    return spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else spark.read.schema(SCHEMA).json(path)


def intervals(advisories: DataFrame) -> DataFrame:
    """The advisories as a table of intervals, one row for each artifact and interval; artifacts in lower case."""
    named = advisories.withColumn("component", F.explode(F.split(F.lower(F.trim("component")), r"\s+")))
    return versions.range_bounds(named).drop("affected")


def refused(advisories: DataFrame) -> DataFrame:
    """Advisories that can never match: no artifact, or ranges of which nothing can be read."""
    readable = versions.range_bounds(advisories).where("low_key IS NOT NULL OR high_key IS NOT NULL").select("cve", "component", "affected").distinct()
    return advisories.where(F.trim("component") != "").join(readable, ["cve", "component", "affected"], "left_anti").unionByName(
        advisories.where(F.col("component").isNull() | (F.trim("component") == "")))


def match_advisories(deps: DataFrame, advisories: DataFrame | None = None) -> DataFrame:
    """Findings for dependencies in an affected range, one per project, component and advisory (first file, version, name).

    deps(project, path, group_id, artifact, version). Each distinct (artifact, version) meets the intervals of its artifact once, so an
    artifact that a third of all projects use costs one row per version of it; the matches then go back to the dependencies.
    A version without a number is in no range; a component is an artifact's whole name, case ignored.
    """
    rules = intervals(built_in(deps.sparkSession) if advisories is None else advisories)
    used = deps.select(F.lower("artifact").alias("component"), "version").where("component IS NOT NULL AND version IS NOT NULL").distinct()
    met = used.withColumn("_key", versions.version_key(F.col("version"))).join(rules, "component").where(versions.inside(F.col("_key")))
    found = durable(met.select(F.col("component").alias("_name"), "version", "rule_name", "cve", "severity", "fix_version").distinct())
    if found.count() <= BROADCAST_ROWS:
        found = F.broadcast(found)
    rows = deps.withColumn("_name", F.lower("artifact")).join(found, ["_name", "version"]).select(
        "project", F.col("path").alias("file"), F.concat_ws(":", F.nullif("group_id", F.lit("")), "artifact").alias("component"), "version", "rule_name", "cve", "severity", "fix_version")
    return component_findings(first_per(rows, ["project", "component", "cve"], ["file", "version", "rule_name"]))
