"""Files coming in: gates, kinds, entity documents, evaluation inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.registry import query
from ..plans.views import Views

c = F.col
#: Kinds by file name ending.
KINDS = {"pdf": "pdf", "png": "image", "jpg": "image", "jpeg": "image", "tiff": "image", "docx": "docx", "doc": "docx", "txt": "txt"}
LEAST, MOST = 100, 10 * 1024 * 1024


def kind_of(name: Column) -> Column:
    ending = F.lower(F.substring_index(name, ".", -1))
    return F.coalesce(F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])[ending], F.lit("unknown"))


KIND_SQL = "CASE lower(regexp_extract(name, '[^.]*$', 0)) " + " ".join(f"WHEN '{k}' THEN '{x}'" for k, x in KINDS.items()) + " ELSE 'unknown' END"


@query("S1_S9_file_gate", f"""SELECT doc_id, {KIND_SQL} AS kind, CASE WHEN mime <> 'application/pdf' THEN 'not a PDF' WHEN n_bytes < {LEAST} THEN 'too small' WHEN n_bytes > {MOST} THEN 'too large' WHEN NOT ends_with(lower(name), '.pdf') THEN 'wrong ending' END AS reject
    FROM (SELECT doc_id, name, mime, length(text) * 700 AS n_bytes FROM files)""")  # fmt: skip
def file_gate(v: Views) -> DataFrame:
    """The first rule that fails names the rejection; null passes."""
    size = F.length("text") * 700
    reject = F.when(c("mime") != "application/pdf", "not a PDF").when(size < LEAST, "too small").when(size > MOST, "too large").when(~F.endswith(F.lower("name"), F.lit(".pdf")), "wrong ending")
    return v.files.select("doc_id", kind_of(c("name")).alias("kind"), reject.alias("reject"))


@query("S2_S5_S8_stored_files", "SELECT doc_id, sha256(text) AS sha256, strlen(text) AS n_bytes, 'uploads/' || source || '/' || CAST(doc_id AS VARCHAR) || '.bin' AS path FROM files")
def stored_files(v: Views) -> DataFrame:
    return v.files.select("doc_id", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("n_bytes"), F.concat(F.lit("uploads/"), "source", F.lit("/"), c("doc_id").cast("string"), F.lit(".bin")).alias("path"))


def read_binary(spark, path: str) -> DataFrame:
    """Whole files: path, modificationTime, length, content, with the digest of the content."""
    return spark.read.format("binaryFile").load(path).withColumn("sha256", F.sha2("content", 256))


def read_text(spark, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("text"), F.lit(1.0).alias("confidence"))


@query("S7_retention", "SELECT id FROM disputes WHERE created_on >= DATE '2001-08-02' - 7")
def retention(v: Views) -> DataFrame:
    return v.disputes.where(c("created_on") >= F.date_sub(F.lit("2001-08-02").cast("date"), 7)).select("id")


@query("S10_S12_process_by_kind", f"SELECT kind, count(*) AS total, count(*) FILTER (WHERE ok) AS successful, count(*) FILTER (WHERE NOT ok) AS failed FROM (SELECT {KIND_SQL} AS kind, {KIND_SQL} IN ('pdf', 'txt') AND length(trim(text)) > 0 AS ok FROM files) GROUP BY kind")
def process_by_kind(v: Views) -> DataFrame:
    """Texts and pages go through, kinds without a reader fail; counts of each kind."""
    seen = v.files.select(kind_of(c("name")).alias("kind"), F.length(F.trim("text")).alias("n"))
    ok = c("kind").isin("pdf", "txt") & (c("n") > 0)
    return seen.groupBy("kind").agg(F.count("*").alias("total"), F.count_if(ok).alias("successful"), F.count_if(~ok).alias("failed"))


def pages_to_blocks(pages: DataFrame) -> DataFrame:
    """Pages (doc_id, page, text) to text blocks: one of each page that is not blank, at confidence 0.85."""
    return pages.where(F.trim("text") != "").select("doc_id", "page", "text", F.lit(0.85).alias("confidence"))


@query("S11_page_blocks", "SELECT doc_id, CAST(page AS INTEGER) AS page, text, 0.85::DOUBLE AS confidence FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS page FROM files) WHERE trim(text) <> ''")
def page_blocks(v: Views) -> DataFrame:
    return pages_to_blocks(v.files.select("doc_id", F.posexplode(F.split("text", "\n")).alias("page", "text")))


ENTITY = "array<struct<type:string,properties:array<struct<type:string,value:string>>>>"


def entities_to_tradelines(documents: DataFrame) -> DataFrame:
    """JSON entities to accounts: kept types, property aliases (the first alias with a value), and a creditor or account."""
    found = documents.select("id", F.explode(F.from_json("entities", ENTITY)).alias("e")).where(c("e.type").isin("tradeline", "account", "credit_account"))
    props = found.select("id", F.map_from_entries(F.transform("e.properties", lambda p: F.struct(p["type"], p["value"]))).alias("p"))

    def alias(*names: str) -> Column:
        return F.coalesce(*[F.nullif(c("p")[n], F.lit("")) for n in names], F.lit(""))

    out = props.select("id", alias("creditor", "creditor_name").alias("creditor"), alias("account_number").alias("account"), alias("balance", "account_balance").alias("balance"))
    return out.where("creditor <> '' or account <> ''")


@query("S16_entities", "SELECT id, creditor_name AS creditor, account_number AS account, account_balance AS balance FROM tradelines WHERE ord % 3 <> 2 AND (creditor_name <> '' OR account_number <> '')")
def entities(v: Views) -> DataFrame:
    pairs = [("creditor_name", "creditor_name"), ("account_number", "account_number"), ("account_balance", "account_balance")]
    props = F.array(*[F.struct(F.lit(n).alias("type"), c(f).alias("value")) for n, f in pairs])
    kind = F.when(c("ord") % 3 == 0, "tradeline").when(c("ord") % 3 == 1, "credit_account").otherwise("page_header")
    return entities_to_tradelines(v.tradelines.select("id", F.to_json(F.array(F.struct(kind.alias("type"), props.alias("properties")))).alias("entities")))


def read_csv(spark, path: str, schema: str) -> DataFrame:
    """Evaluation rows with a declared schema."""
    return spark.read.schema(schema).option("header", True).csv(path)


def read_json(spark, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


@query("S23_S24_S25_packet_paths", """SELECT user_id, id, user_id || '/' || document_type || '/' || id || '.pdf' AS path, CASE WHEN starts_with(content_type, 'image/') THEN 'image' WHEN content_type = 'application/pdf' THEN 'pdf' ELSE 'skipped' END AS kind, row_number() OVER (PARTITION BY user_id ORDER BY document_type, id) AS entry FROM user_documents""")
def packet_paths(v: Views) -> DataFrame:
    kind = F.when(F.startswith("content_type", F.lit("image/")), "image").when(c("content_type") == "application/pdf", "pdf").otherwise("skipped")
    order = Window.partitionBy("user_id").orderBy("document_type", "id")
    return v.user_documents.select("user_id", "id", F.concat(F.concat_ws("/", "user_id", "document_type", "id"), F.lit(".pdf")).alias("path"), kind.alias("kind"), F.row_number().over(order).cast("long").alias("entry"))


@query("S26_S28_encrypted_fields", "SELECT user_id, ssn, to_base64(encode(ssn)) AS encoded FROM profiles")
def encrypted_fields(v: Views) -> DataFrame:
    """AES-GCM round trip (a random nonce comes first in the cipher text) and base64."""
    key = F.lit("0123456789abcdef").cast("binary")
    sealed = v.profiles.select("user_id", F.aes_encrypt(c("ssn").cast("binary"), key, F.lit("GCM")).alias("sealed"), F.base64(c("ssn").cast("binary")).alias("encoded"))
    return sealed.select("user_id", F.aes_decrypt("sealed", key, F.lit("GCM")).cast("string").alias("ssn"), "encoded")


ITEM = "id string, creditorName string, accountNumber string, amount double, dateReported string, bureaus array<string>, reason string, status string"


@query("S33_nested_items", r"""WITH i AS (SELECT ord, unnest(CAST(json_extract(response, '$.negativeItems') AS JSON[])) AS x FROM scan_responses)
    SELECT ord, json_extract_string(x, '$.id') AS id, json_extract_string(x, '$.creditorName') AS creditor_name, json_extract_string(x, '$.accountNumber') AS account_number, CAST(json_extract_string(x, '$.amount') AS DOUBLE) AS amount, json_extract_string(x, '$.dateReported') AS date_reported,
        array_to_string(CAST(json_extract(x, '$.bureaus') AS VARCHAR[]), ',') AS bureaus, json_extract_string(x, '$.reason') AS reason, json_extract_string(x, '$.status') AS status FROM i""")  # fmt: skip
def nested_items(v: Views) -> DataFrame:
    """Eight fields of each negative item in the responses of a scan, which are JSON with a nested list."""
    items = F.from_json("response", f"negativeItems array<struct<{', '.join(f.replace(' ', ':', 1) for f in ITEM.split(', '))}>>")["negativeItems"]
    i = v.scan_responses.select("ord", F.inline(items))
    return i.select("ord", "id", c("creditorName").alias("creditor_name"), c("accountNumber").alias("account_number"), "amount", c("dateReported").alias("date_reported"), F.array_join("bureaus", ",").alias("bureaus"), "reason", "status")
