"""Security signals in a piece of code: inputs, sinks, safety and validation, by file extension."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from riskloom.functions import texts

GROUPS = ("input", "sink", "safety", "validation")

# Signals of any language, then of one extension.
COMMON = {
    "input": [r"\b(upload|file|filename|filepath|path|callback|redirect)\b"],
    "sink": [r"\b(eval|exec)\b", r"""\b(select|insert|update|delete)\b.*(\+|format\(|f"|sprintf\()""",
             r"\b(innerHTML|dangerouslySetInnerHTML|document\.write)\b"],
    "safety": [r"\b(whitelist|allowlist)\b", r"\b(parameterized|prepared|placeholder)\b"],
    "validation": [r"\b(validate|sanitize|escape|check|verify|guard|filter)\b",
                   r"\b(auth|authorize|permission|acl|role|requiredLogin|requiredAuth)\b",
                   r"\b(is_safe|safe_path|normalized|canonical)\b"],
}
BY_EXTENSION = {
    "py": {
        "input": [r"\brequest\.(args|form|json|values|files)\b", r"\b(input|sys\.argv|os\.environ|getenv)\b"],
        "sink": [r"\b(subprocess\.(run|Popen|call)|os\.system)\b", r"\b(pickle\.load|pickle\.loads|yaml\.load)\b",
                 r"\b(requests\.(get|post|request))\b", r"\b(open|Path\.open|read_text|write_text)\b",
                 r"\b(sqlite3|pymysql|psycopg2|sqlalchemy)\b"],
        "safety": [r"\b(yaml\.safe_load|html\.escape|markupsafe\.escape)\b", r"\b(pathlib\.Path|resolve\(\))\b",
                   r"\b(subprocess\.(run|Popen)\s*\(\s*\[)\b"],
        "validation": [r"\b(pydantic|validator|marshmallow|schema\.load)\b"],
    },
    "js": {
        "input": [r"\b(req|request)\.(query|body|params|headers|files)\b",
                  r"\b(process\.env|window\.location|document\.location)\b"],
        "sink": [r"\b(child_process\.(exec|spawn|execSync))\b", r"\b(require\s*\(|import\s*\()\b",
                 r"\b(fetch|axios\.(get|post|request))\b",
                 r"\b(fs\.(readFile|readFileSync|writeFile|writeFileSync|createReadStream|createWriteStream))\b"],
        "safety": [r"\b(path\.normalize|path\.resolve)\b", r"\b(DOMPurify|validator\.)\b"],
        "validation": [r"\b(zod|joi|yup|express-validator)\b"],
    },
    "ts": {
        "input": [r"\b(req|request)\.(query|body|params|headers|files)\b", r"\b(process\.env)\b"],
        "sink": [r"\b(child_process\.(exec|spawn|execSync))\b", r"\b(fetch|axios\.(get|post|request))\b",
                 r"\b(fs\.(readFile|readFileSync|writeFile|writeFileSync))\b"],
        "safety": [r"\b(path\.normalize|path\.resolve)\b"],
        "validation": [r"\b(zod|joi|class-validator|nestjs\/common)\b"],
    },
    "java": {
        "input": [r"\b(request\.getParameter|@RequestParam|@PathVariable|@RequestBody)\b", r"\b(System\.getenv|MultipartFile)\b"],
        "sink": [r"\b(Runtime\.getRuntime\(\)\.exec|ProcessBuilder)\b", r"\b(HttpURLConnection|RestTemplate|WebClient)\b",
                 r"\b(FileInputStream|FileOutputStream|Files\.(read|write))\b",
                 r"\b(Statement|createStatement|executeQuery|executeUpdate)\b"],
        "safety": [r"\b(PreparedStatement|@PreAuthorize|hasRole)\b", r"\b(Paths\.get|normalize\(\)|toRealPath\(\))\b"],
        "validation": [r"\b(@Valid|Validator|BindingResult)\b"],
    },
    "go": {
        "input": [r"\b(r\.URL\.Query|FormValue|PostFormValue|ShouldBindJSON|BindJSON)\b",
                  r"\b(os\.Getenv|c\.Param|c\.Query|c\.PostForm)\b"],
        "sink": [r"\b(exec\.Command|sql\.DB|QueryRow|Query|Exec)\b", r"\b(http\.Get|http\.Post|client\.Do)\b",
                 r"\b(os\.Open|os\.Create|ioutil\.ReadFile|os\.WriteFile)\b", r"\b(template\.HTML|text\/template)\b"],
        "safety": [r"\b(html\/template|filepath\.Clean|filepath\.Join)\b", r"\b(PrepareContext|QueryContext|ExecContext)\b"],
        "validation": [r"\b(validator\.New|ShouldBind|binding:)\b"],
    },
    "php": {
        "input": [r"\b(_GET|_POST|_REQUEST|_FILES|_COOKIE|_SERVER|_ENV)\b"],
        "sink": [r"\b(include|include_once|require|require_once)\b", r"\b(system|exec|shell_exec|passthru|proc_open)\b",
                 r"\b(mysqli_query|query|exec|PDO)\b", r"\b(file_get_contents|fopen|fwrite|readfile)\b", r"\b(unserialize)\b"],
        "safety": [r"\b(PDO::prepare|prepare\s*\(|realpath|basename)\b"],
        "validation": [r"\b(filter_input|htmlspecialchars|preg_match)\b"],
    },
    "c": {
        "input": [r"\b(argv|getenv|recv|read|fgets|scanf)\b"],
        "sink": [r"\b(system|popen|execl|execv|sprintf|strcpy|strcat|gets)\b", r"\b(fopen|open|write|read)\b"],
        "safety": [r"\b(snprintf|strncpy|realpath)\b"],
        "validation": [r"\b(strlen|sizeof|strncmp|memcmp)\b"],
    },
    "cpp": {
        "input": [r"\b(argv|getenv|recv|read|std::cin)\b"],
        "sink": [r"\b(system|popen|sprintf|strcpy|strcat)\b", r"\b(std::ifstream|std::ofstream|fstream)\b"],
        "safety": [r"\b(snprintf|std::filesystem::canonical|std::array)\b"],
        "validation": [r"\b(std::regex|std::clamp|size\(\))\b"],
    },
    "cs": {
        "input": [r"\b(Request\.(Query|Form|Body|Headers)|IFormFile)\b", r"\b(Environment\.GetEnvironmentVariable)\b"],
        "sink": [r"\b(Process\.Start|SqlCommand|ExecuteReader|ExecuteNonQuery)\b",
                 r"\b(File\.(ReadAllText|WriteAllText|OpenRead|OpenWrite))\b", r"\b(HttpClient\.(GetAsync|PostAsync|SendAsync))\b"],
        "safety": [r"\b(Path\.GetFullPath|Path\.Combine|SqlParameter)\b", r"\b(Authorize|RequireRole)\b"],
        "validation": [r"\b(ModelState\.IsValid|DataAnnotations|FluentValidation)\b"],
    },
}


def hint_profile(text: Column, ext: Column) -> Column:
    """struct(input_count, sink_count, safety_count, validation_count); zero for an extension without signals.

    Each pattern counts once per text. The common patterns are tested once for all extensions.
    """
    key = F.regexp_replace(F.lower(F.coalesce(ext, F.lit(""))), r"^\.", "")
    key = F.when(key == "jsx", "js").when(key == "tsx", "ts").otherwise(key)
    counts = []
    for group in GROUPS:
        per = F.lit(0)
        chain = None
        for name, groups in BY_EXTENSION.items():
            n = texts.count_matching(text, groups[group])
            chain = F.when(key == name, n) if chain is None else chain.when(key == name, n)
        per = chain.otherwise(0) + texts.count_matching(text, COMMON[group])
        counts.append(F.when(key.isin(list(BY_EXTENSION)), per).otherwise(0).alias(f"{group}_count"))
    return F.struct(*counts)


def hint_score(profile: Column) -> Column:
    return (profile["input_count"] * 8 + profile["sink_count"] * 10 + profile["validation_count"] * 3
            + profile["safety_count"] * 2)
