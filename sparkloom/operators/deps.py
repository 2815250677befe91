"""Declared and imported dependencies: drift, licences, bill of materials, stack."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import code as C
from sparkloom.operators.findings import licence_kind, licence_of

#: Licences of well-known packages.  Fixed values.
KNOWN = {
    "react": "MIT", "react-dom": "MIT", "vue": "MIT", "express": "MIT", "lodash": "MIT", "axios": "MIT", "typescript": "Apache-2.0", "next": "MIT",
    "tailwindcss": "MIT", "eslint": "MIT", "prettier": "MIT", "mocha": "MIT", "jest": "MIT", "vite": "MIT", "fastapi": "MIT", "django": "BSD-3-Clause",
    "flask": "BSD-3-Clause", "requests": "Apache-2.0", "pytest": "MIT", "numpy": "BSD-3-Clause", "pandas": "BSD-3-Clause", "tokio": "MIT",
    "serde": "MIT / Apache-2.0", "gin": "MIT", "fiber": "MIT",
}
#: Modules that come with the runtime.  Fixed values.
BUILTIN = (
    "fs", "path", "http", "https", "url", "crypto", "os", "stream", "util", "events", "child_process", "buffer", "assert", "net", "zlib", "tls", "dns", "perf_hooks", "worker_threads",
)


def inferred_licence(name: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in KNOWN.items() for x in pair))
    plain = F.regexp_replace(F.lower(name), "^@[^/]+/", "")
    return F.coalesce(F.element_at(known, name), F.element_at(known, plain), F.lit("Permissive (Inferred)"))


def bill_of_materials(declared: DataFrame) -> DataFrame:
    """name, version, ecosystem, dev, licence, kind; declared: label, version, ecosystem, dev."""
    out = declared.withColumn("licence", inferred_licence(F.col("label"))).withColumn("kind", licence_kind(F.col("licence")))
    return out.withColumn("version", C.clean_version(F.col("version")))


def licence_counts(bom: DataFrame, project: str = "permissive") -> DataFrame:
    of = lambda k: F.count_if(F.col("kind") == k)
    out = bom.agg(of("permissive").alias("permissive"), of("copyleft").alias("copyleft"), of("weak-copyleft").alias("weak"), F.count(F.lit(1)).alias("total"))
    return out.withColumn("unknown", F.col("total") - F.col("permissive") - F.col("copyleft") - F.col("weak")).withColumn("status", F.when((F.col("copyleft") > 0) & F.lit(project == "permissive"), "warning").otherwise("clean"))


def unused(declared: DataFrame, imported: DataFrame) -> DataFrame:
    return declared.select("name").distinct().join(imported, "name", "left_anti")


def undeclared(declared: DataFrame, imported: DataFrame, builtin: DataFrame) -> DataFrame:
    return imported.select("name").distinct().join(declared, "name", "left_anti").join(builtin, "name", "left_anti")


def externals(imported: DataFrame) -> DataFrame:
    """name, users: distinct importing files."""
    return imported.groupBy("name").agg(F.countDistinct("src").alias("users"))


def stack(declared: DataFrame, most: int = 48) -> DataFrame:
    """Packages by category and name, each once."""
    rank = F.array_position(F.array(*map(F.lit, ("npm", "pip", "go", "cargo"))), F.col("ecosystem"))
    once = declared.groupBy("label").agg(F.min("ecosystem").alias("ecosystem"))
    return once.orderBy(rank, "label").limit(most)


#: Category and documentation of known packages.  Fixed values.
STACK = {
    "react": ("Frontend framework", "https://react.dev"), "react-dom": ("Frontend framework", "https://react.dev"), "@angular/core": ("Frontend framework", "https://angular.dev"),
    "vue": ("Frontend framework", "https://vuejs.org"), "svelte": ("Frontend framework", "https://svelte.dev"), "next": ("Web framework", "https://nextjs.org/docs"),
    "nuxt": ("Web framework", "https://nuxt.com/docs"), "remix": ("Web framework", "https://remix.run/docs"), "gatsby": ("Web framework", "https://www.gatsbyjs.com/docs"),
    "express": ("Web framework", "https://expressjs.com"), "fastify": ("Web framework", "https://fastify.dev"), "koa": ("Web framework", "https://koajs.com"),
    "@nestjs/core": ("Web framework", "https://docs.nestjs.com"), "hapi": ("Web framework", "https://hapi.dev"), "flask": ("Web framework", "https://flask.palletsprojects.com"),
    "django": ("Web framework", "https://docs.djangoproject.com"), "fastapi": ("Web framework", "https://fastapi.tiangolo.com"), "spring-boot": ("Web framework", "https://docs.spring.io/spring-boot"),
    "laravel": ("Web framework", "https://laravel.com/docs"), "rails": ("Web framework", "https://guides.rubyonrails.org"), "gin": ("Web framework", "https://gin-gonic.com"),
    "echo": ("Web framework", "https://echo.labstack.com"), "fiber": ("Web framework", "https://gofiber.io"), "actix-web": ("Web framework", "https://actix.rs"),
    "axum": ("Web framework", "https://docs.rs/axum"), "rocket": ("Web framework", "https://rocket.rs"), "prisma": ("Database / ORM", "https://www.prisma.io/docs"),
    "sequelize": ("Database / ORM", "https://sequelize.org"), "typeorm": ("Database / ORM", "https://typeorm.io"), "sqlalchemy": ("Database / ORM", "https://docs.sqlalchemy.org"),
    "drizzle-orm": ("Database / ORM", "https://orm.drizzle.team"), "mongoose": ("Database / ORM", "https://mongoosejs.com"), "knex": ("Database / ORM", "https://knexjs.org"),
    "pg": ("Database / ORM", "https://node-postgres.com"), "pymongo": ("Database / ORM", "https://pymongo.readthedocs.io"), "gorm": ("Database / ORM", "https://gorm.io"),
    "sqlx": ("Database / ORM", "https://docs.rs/sqlx"), "diesel": ("Database / ORM", "https://diesel.rs"), "redis": ("Database / ORM", "https://redis.io/docs/"),
    "jest": ("Testing", "https://jestjs.io"), "vitest": ("Testing", "https://vitest.dev"), "mocha": ("Testing", "https://mochajs.org"),
    "@testing-library/react": ("Testing", "https://testing-library.com"), "pytest": ("Testing", "https://docs.pytest.org"), "playwright": ("Testing", "https://playwright.dev"),
    "cypress": ("Testing", "https://docs.cypress.io"), "rspec": ("Testing", "https://rspec.info"), "typescript": ("Tooling / build", "https://www.typescriptlang.org/docs"),
    "vite": ("Tooling / build", "https://vitejs.dev/guide/"), "webpack": ("Tooling / build", "https://webpack.js.org"), "esbuild": ("Tooling / build", "https://esbuild.github.io"),
    "babel": ("Tooling / build", "https://babeljs.io/docs"), "rollup": ("Tooling / build", "https://rollupjs.org"), "tailwindcss": ("UI / styling", "https://tailwindcss.com/docs"),
    "bootstrap": ("UI / styling", "https://getbootstrap.com/docs"), "sass": ("UI / styling", "https://sass-lang.com/documentation"), "styled-components": ("UI / styling", "https://styled-components.com"),
    "axios": ("Networking", "https://axios-http.com"), "requests": ("Networking", "https://requests.readthedocs.io"), "urllib3": ("Networking", "https://urllib3.readthedocs.io"),
    "httpx": ("Networking", "https://www.python-httpx.org"), "passport": ("Auth", "https://www.passportjs.org"), "next-auth": ("Auth", "https://next-auth.js.org"),
    "jsonwebtoken": ("Auth", "https://github.com/auth0/node-jsonwebtoken"), "pydantic": ("Data validation", "https://docs.pydantic.dev"), "numpy": ("Data / science", "https://numpy.org/doc/"),
    "pandas": ("Data / science", "https://pandas.pydata.org/docs/"), "scikit-learn": ("Data / science", "https://scikit-learn.org/stable/"), "torch": ("Data / science", "https://pytorch.org/docs/"),
    "tensorflow": ("Data / science", "https://www.tensorflow.org/api_docs"), "opencv-python": ("Data / science", "https://docs.opencv.org"), "keras": ("Data / science", "https://keras.io"),
    "python-dotenv": ("Tooling / config", "https://github.com/theskumar/python-dotenv"),
}
#: Categories in the order in which they are shown.  Fixed values.
CATEGORIES = (
    "Web framework", "Frontend framework", "Database / ORM", "Auth", "Networking", "Data / science", "Data validation", "UI / styling", "Testing", "Tooling / build", "Tooling / config", "Library",
)
#: Where an ecosystem shows its packages: before and after the name, and its language.  Fixed values.
REGISTRIES = {
    "npm": ("https://www.npmjs.com/package/", "", "JavaScript"), "pip": ("https://pypi.org/project/", "/", "Python"), "go": ("https://pkg.go.dev/", "", "Go"), "cargo": ("https://docs.rs/", "", "Rust"),
}


def _host(url: Column) -> Column:
    return F.regexp_extract(url, r"^https?://(?:www\.)?([^/]+)", 1)


def stack_items(declared: DataFrame, most: int = 48) -> DataFrame:
    """name, version, category, lang, docs, dev of declared packages (label, ecosystem, version, dev), each name once, by category.

    Go packages are known by the last part of their path and shown at their registry.
    """
    spark = declared.sparkSession
    known = spark.createDataFrame([(k, c, u) for k, (c, u) in STACK.items()], "key string, category string, docs string")
    registry = spark.createDataFrame([(k, *v) for k, v in REGISTRIES.items()], "ecosystem string, before string, after string, lang string")
    rank = F.array_position(F.array(*map(F.lit, REGISTRIES)), F.col("ecosystem"))
    once = declared.where("label <> 'react-dom' or ecosystem <> 'npm'").groupBy("label").agg(F.min(F.struct(rank.alias("rank"), "dev", "ecosystem", "version")).alias("d")).select("label", "d.*")
    key = F.when(F.col("ecosystem") == "go", F.substring_index("label", "/", -1)).when((F.col("ecosystem") == "cargo") & ~F.col("label").isin(*STACK), F.replace("label", F.lit("_"), F.lit("-"))).otherwise(F.col("label"))
    out = once.withColumn("key", key).join(F.broadcast(known), "key", "left").join(F.broadcast(registry), "ecosystem", "left")  # fixed tables
    category = F.coalesce("category", F.lit("Library"))
    docs = F.when(F.col("docs").isNotNull() & (F.col("ecosystem") != "go"), F.col("docs")).otherwise(F.concat("before", "label", "after"))
    version = F.when(F.col("ecosystem") == "npm", C.clean_version(F.col("version"))).otherwise("")
    shown = out.select(F.col("label").alias("name"), version.alias("version"), category.alias("category"), "lang", docs.alias("docs"), "dev")
    return shown.orderBy(F.array_position(F.array(*map(F.lit, CATEGORIES)), F.col("category")), "name").limit(most)


def doc_hosts() -> list[str]:
    """Hosts of all documentation that ``stack_items`` can name: a fetch of others is refused."""
    urls = [u for _, u in STACK.values()] + [b + "any" + a for b, a, _ in REGISTRIES.values()]
    return sorted({u.split("/")[2].removeprefix("www.") for u in urls})


def doc_allowed(url: Column) -> Column:
    return url.startswith("https://") & _host(url).isin(*doc_hosts())


def project_licence(files: DataFrame, declared: DataFrame) -> DataFrame:
    """id, kind, source of a project's licence: the first licence file at the root, else the manifest's word, else unknown.

    files: path, text; declared: licence (one row at most).  A licence file of no known text is Custom.
    """
    named = files.where(F.col("path").rlike("(?i)^(LICENSE|COPYING|UNLICENSE)[^/]*$")).orderBy("path").limit(1)
    own = named.select(F.lit(1).alias("rank"), F.coalesce(licence_of(F.coalesce("text", F.lit(""))), F.lit("Custom")).alias("id"), F.col("path").alias("source"))
    said = declared.where("licence is not null and licence <> ''").limit(1).select(F.lit(2).alias("rank"), F.col("licence").alias("id"), F.lit("manifest").alias("source"))
    none = files.sparkSession.createDataFrame([(3, "UNKNOWN", "")], "rank int, id string, source string")
    best = own.unionByName(said).unionByName(none).orderBy("rank").limit(1)
    return best.select("id", licence_kind(F.col("id")).alias("kind"), "source")


REMOTE = (
    "stargazers_count double, forks_count double, subscribers_count double, open_issues_count double, description string, license struct<spdx_id:string>, created_at string, pushed_at string, "
    "default_branch string, topics array<string>, homepage string, archived boolean"
)


def remote_facts(text: Column) -> Column:
    """What a code host says of a repository (JSON), cleaned; null for what is no object."""
    j = F.from_json(text, REMOTE)
    count = lambda c: F.when(F.coalesce(j[c], F.lit(0.0)) >= 0, F.floor(F.coalesce(j[c], F.lit(0.0)))).otherwise(0).cast("long")
    word = lambda c: F.trim(F.coalesce(j[c], F.lit("")))
    licence = j["license"]["spdx_id"]
    facts = F.struct(
        count("stargazers_count").alias("stars"), count("forks_count").alias("forks"), count("subscribers_count").alias("watching"), count("open_issues_count").alias("issues"), word("description").alias("description"),
        F.when(licence != "NOASSERTION", licence).otherwise("").alias("licence"), word("created_at").alias("created"), word("pushed_at").alias("pushed"), word("default_branch").alias("branch"),
        F.slice(F.filter(F.coalesce(j["topics"], F.array().cast("array<string>")), lambda t: t != ""), 1, 12).alias("topics"), word("homepage").alias("homepage"), F.coalesce(j["archived"], F.lit(False)).alias("archived"),
    )
    return F.when(F.trim(text).startswith("{"), facts)


def remote_error(status: Column) -> Column:
    """Why a code host gave no facts: each status asks for something else."""
    return (
        F.when(status == 403, "The host's hourly allowance is used up.").when(status == 404, "The host has no such repository, or it is private.")
        .when(status == 429, "The host asks to slow down; try again in a minute.").otherwise(F.concat(F.lit("The host answered "), status.cast("string"), F.lit(".")))
    )
