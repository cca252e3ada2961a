"""JSON corpora as DataFrames: an organisation's files, and a repository snapshot."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

USER = "struct<userId:string,timestamp:string,text:string,utteranceID:string>"
PERSON_KEYS = ("employee_id", "id", "userId", "user_id", "eid", "name")
PRODUCT = f"""team array<string>, customers array<string>,
  slack array<struct<id:string,Channel:struct<name:string,channelID:string>,Message:struct<User:{USER}>,ThreadReplies:array<struct<User:{USER}>>>>,
  documents array<struct<id:string,content:string,date:string,author:string,document_link:string,type:string>>,
  meeting_transcripts array<struct<id:string,transcript:string,date:string,document_type:string,participants:array<string>>>,
  meeting_chats array<struct<id:string,text:string>>, urls array<struct<id:string,link:string,description:string>>,
  prs array<struct<id:string,title:string,summary:string,link:string,merged:string,state:string,number:long,user:string,created_at:string,reviews:array<string>>>,
  answerable_questions array<struct<question:string,ground_truth:string,citations:array<string>,type:string>>, unanswerable_questions array<string>"""
SNAPSHOT = """owner string, fetchedAt string, repos array<struct<name:string,fullName:string,private:boolean,description:string,collaborators:array<string>>>,
  issues array<struct<repo:string,number:long,title:string,body:string,author:string,createdAt:string,url:string,comments:array<struct<author:string,body:string,createdAt:string>>>>,
  teams array<struct<slug:string,name:string,parent:string,members:array<string>,repos:array<string>>>"""


@dataclass
class Corpus:
    """sources (source_id, id, space, kind, text, title, author, participants, ord), memberships, reporting lines, questions."""

    sources: DataFrame
    member_of: DataFrame
    manages: DataFrame
    employees: DataFrame
    questions: DataFrame | None = None


def person(c):
    """A person given as a text or as an object in JSON: the first key of an object that is filled."""
    keys = [F.get_json_object(c, f"$.{k}") for k in PERSON_KEYS]
    return F.when(c.startswith("{"), F.coalesce(*[F.nullif(k, F.lit("")) for k in keys])).otherwise(c)


def org_tree(node, manager: str | None = None):
    """(manager, report) of a nested tree: any list of objects in a node holds its reports."""
    for x in node if isinstance(node, list) else [node]:
        me = x.get("employee_id")
        if me and manager:
            yield manager, me
        for v in x.values():
            if isinstance(v, list) and any(isinstance(y, dict) for y in v):
                yield from org_tree([y for y in v if isinstance(y, dict)], me or manager)


def _kind(products: DataFrame, field: str, kind: str, **cols) -> DataFrame:
    x = products.select("space", F.posexplode(field).alias("i", "x"))
    made = F.concat_ws("-", "space", F.lit(kind), F.col("i").cast("string"))
    none = F.lit(None).cast("string")
    get = lambda k: cols.get(k, none)
    return x.select(
        F.coalesce(F.nullif(F.col("x.id"), F.lit("")), made).alias("id"), "space", F.lit(kind).alias("kind"), cols["text"].alias("text"), get("title").alias("title"), get("author").alias("author"),
        cols.get("participants", F.array().cast("array<string>")).alias("participants"), get("date").alias("date"), get("locator").alias("locator"), F.col("i").alias("ord"),
    )


def artifacts(products: DataFrame) -> DataFrame:
    """The sources of all kinds; empty texts are left out, and ids are scoped by their space."""
    c = F.col
    replies = F.transform("x.ThreadReplies", lambda r: r["User"]["text"])
    voices = F.array_distinct(F.filter(F.concat(F.array(c("x.Message.User.userId")), F.coalesce(F.transform("x.ThreadReplies", lambda r: r["User"]["userId"]), F.array().cast("array<string>"))), lambda p: p.isNotNull()))
    out = (
        _kind(products, "slack", "slack", text=F.concat_ws("\n", c("x.Message.User.text"), F.concat_ws("\n", replies)), author=c("x.Message.User.userId"), participants=voices, title=c("x.Channel.name"), date=c("x.Message.User.timestamp"))
        .unionByName(_kind(products, "documents", "document", text=c("x.content"), author=person(c("x.author")), date=c("x.date"), title=c("x.type"), locator=c("x.document_link")))
        .unionByName(_kind(products, "meeting_transcripts", "meeting_transcript", text=c("x.transcript"), participants=F.transform("x.participants", person), date=c("x.date"), title=c("x.document_type")))
        .unionByName(_kind(products, "meeting_chats", "meeting_chat", text=c("x.text")))
        .unionByName(_kind(products, "urls", "url", text=c("x.description"), locator=c("x.link")))
        .unionByName(_kind(products, "prs", "pr", text=F.concat_ws("\n", F.nullif("x.title", F.lit("")), F.nullif("x.summary", F.lit(""))), author=person(c("x.user")), title=c("x.title"), locator=c("x.link"), date=c("x.created_at")))
    )
    return out.filter("trim(coalesce(text, '')) != ''").withColumn("source_id", F.concat_ws("::", "space", "id"))


def load(spark: SparkSession, root: str) -> Corpus:
    """employee.json, salesforce_team.json and products/*.json below ``root``."""
    whole = lambda name: spark.read.text(f"{root}/{name}", wholetext=True)
    staff = whole("employee.json").select(F.explode(F.from_json("value", "map<string,struct<name:string,role:string,location:string,org:string>>")).alias("id", "e")).select("id", "e.*")
    schema = T.StructType().add("manager", "string").add("report", "string")

    def walk(batches):
        import pandas as pd

        for pdf in batches:
            rows = [p for v in pdf["value"] for p in org_tree(json.loads(v))]
            yield pd.DataFrame(rows, columns=["manager", "report"])

    manages = whole("salesforce_team.json").mapInPandas(walk, schema)
    space = F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1)
    products = spark.read.schema(PRODUCT).option("multiLine", True).json(f"{root}/products/*.json").withColumn("space", space)
    members = products.select("space", F.explode("team").alias("principal")).select("principal", "space").distinct()
    asked = products.select("space", F.explode("answerable_questions").alias("q")).select("space", "q.*", F.lit(True).alias("answerable"))
    other = products.select("space", F.explode("unanswerable_questions").alias("u")).select(
        "space", F.coalesce(F.get_json_object("u", "$.question"), F.col("u")).alias("question"), F.lit(None).cast("string").alias("ground_truth"), F.array().cast("array<string>").alias("citations"),
        F.get_json_object("u", "$.type").alias("type"), F.lit(False).alias("answerable"),
    )
    return Corpus(artifacts(products), members, manages, staff, asked.unionByName(other))


def load_snapshot(spark: SparkSession, path: str) -> Corpus:
    """A snapshot of repositories, issues and teams; child teams inherit what their parents may read, and everyone may read public repositories."""
    from ..operators.loops import transitive

    s = spark.read.schema(SNAPSHOT).option("multiLine", True).json(path)
    repos = s.select("owner", F.explode("repos").alias("r")).select("owner", "r.*")
    teams = s.select(F.explode("teams").alias("t")).select("t.*")
    up = transitive(teams.filter("parent is not null").select(F.col("slug").alias("child"), "parent"))[0]
    own = teams.select(F.col("slug").alias("team"), F.explode("repos").alias("space"))
    inherited = up.join(own, up["parent"] == own["team"]).select(F.col("child").alias("team"), "space")
    by_team = own.union(inherited).distinct().join(teams.select(F.col("slug").alias("team"), F.explode("members").alias("principal")), "team").select("principal", "space")
    direct = repos.select(F.explode("collaborators").alias("principal"), F.col("name").alias("space")).union(repos.select("owner", "name"))
    accounts = direct.select("principal").union(by_team.select("principal")).union(spark.createDataFrame([("public",)], "principal string")).distinct()
    public = accounts.crossJoin(repos.filter("not private").select(F.col("name").alias("space")))
    issues = s.select(F.explode("issues").alias("x")).select("x.*")
    text = F.concat_ws("\n", F.nullif("title", F.lit("")), F.nullif("body", F.lit("")), F.nullif(F.concat_ws("\n", F.transform("comments", lambda c: c["body"])), F.lit("")))
    voices = F.array_distinct(F.concat(F.array("author"), F.coalesce(F.transform("comments", lambda c: c["author"]), F.array().cast("array<string>"))))
    sources = issues.select(
        F.col("number").cast("string").alias("id"), F.col("repo").alias("space"), F.lit("document").alias("kind"), text.alias("text"), "title", "author", voices.alias("participants"),
        F.col("createdAt").alias("date"), F.col("url").alias("locator"), F.col("number").cast("int").alias("ord"), F.concat_ws("::", "repo", F.col("number").cast("string")).alias("source_id"),
    ).filter("trim(text) != ''")
    staff = accounts.select(F.col("principal").alias("id"), F.col("principal").alias("name"))
    nobody = spark.createDataFrame([], "manager string, report string")
    return Corpus(sources, direct.union(by_team).union(public).distinct(), nobody, staff)


def write_graph(edges: dict[str, DataFrame], out: str) -> None:
    """The graph as one Parquet table per edge kind."""
    for kind, df in edges.items():
        df.write.mode("overwrite").parquet(f"{out}/{kind.lower()}")


def customers(spark: SparkSession, path: str) -> DataFrame:
    """name: the distinct names of customers in a JSON list, or in an object of them, under company, name or customer."""
    entry = "struct<company:string,name:string,customer:string>"
    whole = spark.read.text(path, wholetext=True)
    listed = F.from_json("value", f"array<{entry}>")
    keyed = F.map_values(F.from_json("value", f"map<string,{entry}>"))
    rows = whole.select(F.explode(F.when(F.ltrim("value").startswith("["), listed).otherwise(keyed)).alias("c"))
    return rows.select(F.explode(F.array("c.company", "c.name", "c.customer")).alias("name")).filter("length(name) > 1").distinct()


def save_snapshot(spark: SparkSession, snapshot: DataFrame, path: str) -> None:
    """A snapshot (one row of :data:`SNAPSHOT`) as JSON, as :func:`load_snapshot` reads it."""
    snapshot.select(*[f.split(" ")[0].strip() for f in ("owner", "fetchedAt", "repos", "issues", "teams")]).coalesce(1).write.mode("overwrite").json(path, ignoreNullFields=False)


# Capitalised words that begin no name.
NO_NAMES = "Do No The This Target Finance General How Not Data Room Access Integration Engineering Northwind Assigning Template".split()


def named_people(texts: DataFrame) -> DataFrame:
    """name: the distinct pairs of capitalised words of three letters or more in (text), but for those that begin no name."""
    pairs = F.explode(F.regexp_extract_all("text", F.lit(r"\b([A-Z][a-z]{2,}\s+[A-Z][a-z]{2,})\b"), F.lit(1)))
    first, last = F.regexp_extract("name", r"^(\S+)", 1), F.regexp_extract("name", r"(\S+)$", 1)
    return texts.select(pairs.alias("name")).filter(~first.isin(NO_NAMES) & ~last.isin(NO_NAMES)).distinct()


def snapshot_stats(spark: SparkSession, path: str) -> DataFrame:
    """One row: owner, fetched_at, repos, private, public, issues, comments, teams, team_grants."""
    s = spark.read.schema(SNAPSHOT).option("multiLine", True).json(path)
    total = lambda rows, part: F.aggregate(rows, F.lit(0), lambda t, x: t + F.greatest(F.size(x[part]), F.lit(0)))
    private = F.size(F.filter("repos", lambda r: r["private"]))
    return s.select(
        "owner", F.col("fetchedAt").alias("fetched_at"), F.size("repos").alias("repos"), private.alias("private"), (F.size("repos") - private).alias("public"), F.size("issues").alias("issues"),
        total("issues", "comments").alias("comments"), F.size("teams").alias("teams"), total("teams", "repos").alias("team_grants"),
    )


def employees_of(ids: DataFrame, employees: DataFrame) -> DataFrame:
    """``ids`` (employee_id) with name, role and org where known."""
    return ids.join(employees.select(F.col("id").alias("employee_id"), *[c for c in employees.columns if c != "id"]), "employee_id", "left")
