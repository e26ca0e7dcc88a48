"""Scans, sinks, projections, joins and orders."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import schemas
from ..functions import expr, fixed, ledger
from ..operators import accounts, lifecycle, matching, receipts
from ..session import shared_dir
from ..sources import readers, writers
from ..sources.scratch import written
from .registry import add, d_minute, d_second, listed, now, second, text

# --- scans -------------------------------------------------------------------------

add("s1_scan_templates", lambda t: readers.scan_templates(t.templates, False).select("template_id", "merchant_name", "usage_count"),
    ("templates",), "SELECT template_id, merchant_name, usage_count FROM templates WHERE NOT is_archived")
add("s2_scan_receipts", lambda t: receipts.scan_receipts(t.receipts, 1).select("receipt_id", "merchant_name", text("total_amount")),
    ("receipts",), "SELECT receipt_id, merchant_name, CAST(total_amount AS VARCHAR) AS total_amount FROM receipts WHERE employee = 1")
add("s3_scan_open_jobs", lambda t: lifecycle.scan_open_jobs(t.jobs, "1").select("job_id", "status", second("created_at").alias("created_at")),
    ("jobs",), f"""SELECT job_id, status, {d_second('created_at')} AS created_at FROM jobs
    WHERE user_id = '1' AND status <> 'confirmed' ORDER BY jobs.created_at DESC, job_id""")
add("s4_read_json_receipts", lambda t: readers.read_json_receipts(t.events, "props", "k long").select(
        "event_id", F.col("data.k").cast("string").alias("k"), "is_corrupt", "template_correspondence"),
    (), """SELECT event_id, json_extract_string(props, '$.k') AS k, NOT json_valid(props) AS is_corrupt,
    CAST(2.0 AS DOUBLE) AS template_correspondence FROM events""")
TYPE_CASE = "CASE lower(regexp_extract(path, '\\.([^./]+)$', 1)) " + " ".join(
    f"WHEN '{e}' THEN '{m}'" for e, m in fixed.EXTENSION_TYPES.items()) + " END"
add("s5_route_files", lambda t: readers.route_files(t.landing_files).select("path", "file_type", "handler", "error"),
    ("landing_files",), f"""SELECT path, ft AS file_type, CASE WHEN contains(ft, 'image') THEN 'image' WHEN contains(ft, 'pdf') THEN 'pdf'
    WHEN contains(ft, 'json') THEN 'json' ELSE 'quarantine' END AS handler,
    CASE WHEN ft = 'application/octet-stream' THEN 'Unsupported file type: ' || ft END AS error
    FROM (SELECT path, coalesce({TYPE_CASE}, 'application/octet-stream') AS ft FROM landing_files)""")
add("s6_admit_uploads", lambda t: readers.admit_uploads(t.landing_files).select("path", listed("reasons").alias("reasons"), "admitted"),
    ("landing_files",), f"""SELECT path, array_to_string(r, ',') AS reasons, len(r) = 0 AS admitted FROM (
    SELECT path, list_filter([
      CASE WHEN lower(regexp_extract(path, '\\.([^./]+)$', 1)) NOT IN ('jpg','jpeg','png','pdf','tiff') THEN 'extension' END,
      CASE WHEN length > 10485760 THEN 'size' END,
      CASE WHEN coalesce({TYPE_CASE}, '') NOT IN ('image/jpeg','image/png','application/pdf','image/tiff') THEN 'type' END],
      lambda x: x IS NOT NULL) AS r FROM landing_files)""")
def landed_accounts(t):
    """Account tables written to a folder and scanned from there with their schemas."""
    base = shared_dir(t.spark, "accounts")
    tables = {"users": t.users, "profiles": t.profiles, "settings": t.settings, "tokens": t.tokens}
    for name, table in tables.items():
        known = schemas_of(name)
        table.select(*[F.col(c).cast(kind).alias(c) for c, kind in known.items() if c in table.columns]).write.parquet(f"{base}/{name}")
    return readers.scan_accounts(t.spark, base)


def schemas_of(name):
    ddl = {"users": schemas.USER, "profiles": schemas.PROFILE, "settings": schemas.SETTINGS, "tokens": schemas.REVOKED_TOKEN}[name]
    return {f.name: f.dataType for f in StructType.fromDDL(ddl.strip()).fields}


add("s7_scan_accounts", lambda t: readers.account_sizes(
        landed_accounts(t), {"users": "user_id", "profiles": "profile_id", "settings": "user_id", "tokens": "token_jti"},
        {"users": "email", "profiles": "manager", "settings": "monthly_expense_limit", "tokens": "user_id"}),
    ("users", "profiles", "settings", "tokens"), """
    SELECT 'users' AS table_name, count(*) AS n, count(DISTINCT CAST(user_id AS VARCHAR)) AS n_keys, max(CAST(email AS VARCHAR)) AS last FROM users
    UNION ALL SELECT 'profiles', count(*), count(DISTINCT profile_id), max(CAST(manager AS VARCHAR)) FROM profiles
    UNION ALL SELECT 'settings', count(*), count(DISTINCT user_id), CAST(max(CAST(monthly_expense_limit AS DECIMAL(10,2))) AS VARCHAR) FROM settings
    UNION ALL SELECT 'tokens', count(*), count(DISTINCT token_jti), max(user_id) FROM tokens""")
add("s8_seed_generic_template", lambda t: readers.seed_generic_template(t.templates).select(
        "template_id", "merchant_name", F.size("field_extractors").alias("n_extractors"), F.size("item_patterns").alias("n_patterns")),
    ("templates",), """SELECT template_id, merchant_name, CAST(cardinality(field_extractors) AS INT) AS n_extractors,
    CAST(len(item_patterns) AS INT) AS n_patterns FROM templates
    UNION ALL SELECT 'G-Generic', 'Generic', 6, 3 WHERE NOT EXISTS (SELECT 1 FROM templates WHERE merchant_name = 'Generic')""")


def uploads(t):
    header = F.when(F.col("status") == "failed", "not json").otherwise(F.concat(
        F.lit('{"original_filename":"'), "original_filename", F.lit('","content_type":"'), "file_type", F.lit('"}')))
    return t.jobs.select(F.concat(F.lit("up/"), "job_id").alias("path"), "user_id", F.col("original_filename").alias("filename"),
                         "file_type", header.alias("header"))


def first_profiles(t):
    return receipts.first_per_key(t.profiles, "user_id", "profile_id").withColumn("user_id", F.col("user_id").cast("string"))


add("s10_create_jobs", lambda t: lifecycle.create_jobs(uploads(t), first_profiles(t), now("2024-02-01 10:00:00")).select(
        "job_id", "user_id", "original_filename", "file_type", "status",
        F.col("metadata")["extension_filename"].alias("extension"), F.col("metadata")["employee_id"].alias("employee_id"),
        F.col("metadata")["temp_expiration"].alias("expires")),
    ("jobs", "profiles"), """
    SELECT sha256('up/' || job_id) AS job_id, j.user_id, original_filename, file_type,
      CASE WHEN j.status = 'failed' THEN 'rejected' ELSE 'pending' END AS status,
      CASE WHEN j.status <> 'failed' THEN regexp_extract(original_filename, '\\.[^.]*$') END AS extension,
      CASE WHEN j.status <> 'failed' THEN employee_id END AS employee_id,
      CASE WHEN j.status <> 'failed' THEN '2024-02-01T14:00:00' END AS expires
    FROM jobs j LEFT JOIN (SELECT user_id, arg_min(employee_id, profile_id) AS employee_id FROM profiles GROUP BY 1) p
      ON CAST(p.user_id AS VARCHAR) = j.user_id""")

# --- sinks -------------------------------------------------------------------------

add("k1_export_csv", lambda t: receipts.export_csv(t.receipts), ("receipts",), f"""
    SELECT CAST(receipt_id AS VARCHAR) AS "ID", merchant_name AS "Merchant", {d_minute('transaction_time')} AS "Date",
      category AS "Category", description AS "Description", CAST(total_amount AS VARCHAR) AS "Total Amount",
      currency AS "Currency", CASE WHEN tax_amount <> 0 THEN CAST(tax_amount AS VARCHAR) ELSE '' END AS "Tax Amount",
      status AS "Status" FROM receipts""")
def full_receipts(t):
    """Receipts with the columns that come from the file and the job, made up from the id; every ninth has no items."""
    n = F.col("receipt_id")
    return t.receipts.withColumns({
        "merchant_address": F.when(n % 3 != 0, F.concat(n.cast("string"), F.lit(" High Street"))), "file_ref": F.concat(F.lit("f"), n.cast("string")),
        "file_ext": F.when(n % 2 == 0, "pdf").otherwise("jpg"), "latitude": F.when(n % 5 != 0, (n % 180 - 90) + F.lit(0.5)),
        "longitude": F.when(n % 5 != 0, (n % 360 - 180) + F.lit(0.25)), "location_name": F.when(n % 5 != 0, F.concat(F.lit("place "), (n % 7).cast("string"))),
        "template_correspondence": (n % 4) / F.lit(4.0), "updated_at": F.col("created_at"),
        "cost_items": F.when(n % 9 != 4, F.transform("cost_items", lambda i: i.withField("unit_price", i["total_price"])))})


def receipt_files(t):
    """A file for two of three receipts."""
    return t.receipts.where("receipt_id % 3 <> 1").select(
        F.concat(F.lit("f"), F.col("receipt_id").cast("string")).alias("file_ref"), F.encode("merchant_name", "UTF-8").alias("content"))


D_STAMP = "strftime({c}, '%Y-%m-%dT%H:%M:%SZ')"
add("k2_export_json", lambda t: receipts.export_json(full_receipts(t), receipt_files(t)), ("receipts",), f"""
    SELECT receipt_id, CAST(json_object('id', CAST(receipt_id AS VARCHAR), 'template_used', template_used,
      'merchant_name', merchant_name, 'transaction_time', {D_STAMP.format(c='transaction_time')},
      'merchant_address', CASE WHEN receipt_id % 3 <> 0 THEN CAST(receipt_id AS VARCHAR) || ' High Street' END,
      'reference_number', reference_number, 'tax_amount', CAST(tax_amount AS VARCHAR), 'category', category,
      'description', description, 'total_amount', CAST(total_amount AS VARCHAR),
      'subtotal_amount', CAST(subtotal_amount AS VARCHAR), 'currency', currency, 'employee', CAST(employee AS VARCHAR),
      'status', status, 'approver', CAST(approver AS VARCHAR), 'upload_date', {D_STAMP.format(c='upload_date')},
      'file', CASE WHEN receipt_id % 3 <> 1 THEN base64(encode(merchant_name)) END, 'file_ext', CASE WHEN receipt_id % 2 = 0 THEN 'pdf' ELSE 'jpg' END,
      'latitude', CASE WHEN receipt_id % 5 <> 0 THEN receipt_id % 180 - 90 + 0.5::DOUBLE END,
      'longitude', CASE WHEN receipt_id % 5 <> 0 THEN receipt_id % 360 - 180 + 0.25::DOUBLE END,
      'location_name', CASE WHEN receipt_id % 5 <> 0 THEN 'place ' || CAST(receipt_id % 7 AS VARCHAR) END,
      'template_correspondence', (receipt_id % 4) / 4.0::DOUBLE, 'created_at', {D_STAMP.format(c='created_at')}, 'updated_at', {D_STAMP.format(c='created_at')},
      'cost_items', CASE WHEN receipt_id % 9 <> 4 THEN list_transform(cost_items, lambda i: {{'item_name': i.item_name, 'unit_price': CAST(i.total_price AS VARCHAR),
        'quantity': CAST(i.quantity AS VARCHAR), 'total_price': CAST(i.total_price AS VARCHAR)}}) ELSE [] END) AS VARCHAR) AS json FROM receipts""")
CLIENT = ["CAST(receipt_id AS VARCHAR)", "merchant_name", d_minute("transaction_time"), "''", "reference_number",
          "CAST(total_amount AS VARCHAR)", "description", "CAST(tax_amount AS VARCHAR)", "category"]
add("k3_export_client_csv", lambda t: receipts.quoted_line(receipts.export_client_csv(t.receipts)), ("receipts",),
    "SELECT " + " || ',' || ".join("'\"' || replace(coalesce(" + c + ", ''), '\"', '\"\"') || '\"'" for c in CLIENT) + " AS line FROM receipts")
add("k5_archive_manifest", lambda t: lifecycle.archive_manifest(t.jobs, t.landing_files, now("2024-02-01 00:00:00")).select(
        "job_id", "user_id", "file_type", text("length"), "archive_status", "error"),
    ("jobs", "landing_files"), """SELECT j.job_id, user_id, file_type, CAST(length AS VARCHAR) AS length,
      CASE WHEN path IS NULL THEN 'failed' ELSE 'completed' END AS archive_status,
      CASE WHEN path IS NULL THEN 'File not found for job ' || j.job_id END AS error
    FROM jobs j LEFT JOIN landing_files f ON f.job_id = j.job_id WHERE status = 'confirmed'""")
add("k6_encode_payload", lambda t: readers.encode_payload(t.landing_files).select("path", "file"),
    ("landing_files",), "SELECT path, base64(encode(content)) AS file FROM landing_files")


def receipt_changes(t):
    """A log in which pending receipts get two partial updates, then some a stranger's change, a deletion or a new start."""
    rows = t.receipts.where("status = 'pending'").select("receipt_id", F.col("employee").alias("o"), "description")
    n, none = F.col("receipt_id"), F.lit(None).cast("string")
    log = F.array(*[F.struct(F.lit(at).alias("at"), who.alias("employee"), F.when(when, op).alias("op"), category.alias("category"), described.alias("description"))
                    for at, who, op, when, category, described in (
        (1, F.col("o"), "update", n > -1, none, F.concat(F.lit("new "), F.coalesce("description", F.lit("")))),
        (2, F.col("o"), "update", n % 2 == 0, F.lit("moved"), none),
        (3, F.col("o") + 1, "delete", n % 5 == 0, none, none),
        (4, F.col("o"), "delete", n % 3 == 1, none, none),
        (5, F.col("o"), "create", n % 6 == 1, none, F.lit("again")),
        (6, F.col("o"), "update", n % 12 == 1, F.lit("late"), none))])
    changed = rows.select("receipt_id", F.explode(F.filter(log, lambda c: c["op"].isNotNull())).alias("c")).select("receipt_id", "c.*")
    created = t.customer.select((F.col("c_custkey") + 100000000).alias("receipt_id"), F.lit(1).alias("at"), F.col("c_custkey").alias("employee"),
                                F.lit("create").alias("op"), F.col("c_mktsegment").alias("category"), F.lit("fresh").alias("description"))
    edited = created.where("employee % 2 = 0").select("receipt_id", F.lit(2).alias("at"), "employee", F.lit("update").alias("op"),
                                                      F.lit("edited").alias("category"), F.lit(None).cast("string").alias("description"))
    return changed.unionByName(created).unionByName(edited)


add("k8_upsert_receipts", lambda t: receipts.upsert_receipts(
        t.receipts.select("receipt_id", "employee", "category", "description"), receipt_changes(t), "receipt_id", "employee", "at"),
    ("receipts",), """
    SELECT receipt_id, employee, CASE WHEN status <> 'pending' THEN category WHEN receipt_id % 12 = 1 THEN 'late' WHEN receipt_id % 6 = 1 THEN NULL
        WHEN receipt_id % 2 = 0 THEN 'moved' ELSE category END AS category,
      CASE WHEN status <> 'pending' THEN description WHEN receipt_id % 6 = 1 THEN 'again' ELSE 'new ' || coalesce(description, '') END AS description
    FROM receipts WHERE NOT (status = 'pending' AND receipt_id % 3 = 1 AND receipt_id % 6 <> 1)
    UNION ALL SELECT c_custkey + 100000000, c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'edited' ELSE c_mktsegment END, 'fresh' FROM customer""")

# --- projections and filters -------------------------------------------------------

add("p1_filter_receipts", lambda t: receipts.filter_receipts(t.receipts, "1996-01-01", "1999-06-30", "BUILDING", "approved").select(
        "receipt_id", "category", "status"), ("receipts",), """SELECT receipt_id, category, status FROM receipts
    WHERE transaction_time >= '1996-01-01' AND transaction_time <= '1999-06-30' AND category = 'BUILDING' AND status = 'approved'""")


def job_requests(t):
    """Requests about jobs; some by other users, some for jobs that do not exist."""
    asker = F.when(F.col("event_id") % 4 == 3, "nobody").otherwise(F.col("user_id").cast("string"))
    job = F.when(F.col("event_id") % 10 == 9, F.concat(F.lit("X"), F.col("event_id").cast("string"))).otherwise(
        F.concat(F.lit("J"), F.lpad(F.col("event_id").cast("string"), 10, "0")))
    return t.events.select(job.alias("job_id"), asker.alias("requester"))


D_REQUESTS = """requests AS (SELECT CASE WHEN event_id % 10 = 9 THEN 'X' || CAST(event_id AS VARCHAR)
    ELSE 'J' || lpad(CAST(event_id AS VARCHAR), 10, '0') END AS job_id,
    CASE WHEN event_id % 4 = 3 THEN 'nobody' ELSE CAST(user_id AS VARCHAR) END AS requester FROM events)"""
add("p2_owned_by", lambda t: receipts.owned_by(job_requests(t), t.jobs, "job_id", "user_id").select("job_id", "requester", "allowed"),
    ("jobs",), f""", {D_REQUESTS} SELECT r.job_id, requester, coalesce(user_id = requester, false) AS allowed
    FROM requests r LEFT JOIN jobs j ON j.job_id = r.job_id""")
add("p3_iexact", lambda t: t.receipts.select(F.upper("merchant_name").alias("hint")).distinct().join(
        t.templates, expr.iexact(F.col("hint"), F.col("merchant_name"))).select("hint", "template_id"),
    ("receipts", "templates"), """SELECT hint, template_id FROM (SELECT DISTINCT upper(merchant_name) AS hint FROM receipts) r
    JOIN templates t ON lower(t.merchant_name) = lower(hint)""")


def first_lines(t):
    return t.noisy_receipts.select("receipt_id", F.split_part("ocr_text", F.lit("\n"), F.lit(1)).alias("hint"))


add("p4_icontains_first_token", lambda t: matching.contains_matches(
        first_lines(t), t.templates.select("template_id", "merchant_name", "usage_count", "is_archived")).select(
        F.col("match_key").alias("word"), "is_archived", "cand_ord", "template_id"),
    ("noisy_receipts", "templates"), """
    SELECT word, is_archived, CAST(row_number() OVER (PARTITION BY word, is_archived ORDER BY usage_count DESC, template_id) AS INT) AS cand_ord, template_id
    FROM (SELECT DISTINCT lower(regexp_extract(trim(split_part(ocr_text, chr(10), 1)), '^\\S*')) AS word FROM noisy_receipts) w
    JOIN templates ON contains(lower(merchant_name), word) QUALIFY cand_ord <= 5""")
add("p5_state_sets", lambda t: receipts.state_filter(t.jobs, ["confirmed", "discarded"], keep=False).select("job_id", "status"),
    ("jobs",), "SELECT job_id, status FROM jobs WHERE status IS NULL OR status NOT IN ('confirmed', 'discarded')")
add("p6_older_than", lambda t: receipts.older_than(t.jobs, "created_at", now("2024-02-10 12:00:00"), 30).select("job_id", second("created_at").alias("created_at")),
    ("jobs",), f"""SELECT job_id, {d_second('created_at')} AS created_at FROM jobs
    WHERE jobs.created_at < TIMESTAMP '2024-02-10 12:00:00' - INTERVAL 30 DAYS""")
API_FIELDS = [("merchant_name", "merchant_name"), ("transaction_time", "date"), ("total_amount", "total_amount"),
              ("merchant_address", "address"), ("reference_number", "reference"), ("tax_amount", "tax"), ("subtotal_amount", "subtotal_amount")]
add("p7_to_api_format", lambda t: t.merge_inputs.select("job_id", receipts.to_api_format(F.col("extracted"), F.col("cost_items")).alias("a")).select(
        "job_id", *[f"a.{o}" for _, o in API_FIELDS],
        F.array_join(F.transform("a.cost_list", lambda i: F.concat_ws("/", i["item"], i["quantity"], i["total"])), ",").alias("cost_list")),
    ("merge_inputs",), "SELECT job_id, " + ", ".join(f"coalesce(extracted['{i}'], '') AS {o}" for i, o in API_FIELDS) + """,
    array_to_string(list_transform(cost_items, lambda i: coalesce(i['item_name'], '') || '/' || coalesce(i['quantity'], '1') || '/' ||
      coalesce(i['total_price'], '')), ',') AS cost_list FROM merge_inputs""")
add("p8_from_api_format", lambda t: t.merge_inputs.select("job_id", receipts.from_api_format(F.col("corrections"), F.col("cost_items")).alias("a")).select(
        "job_id", *[f"a.{i}" for i, _ in API_FIELDS], "a.currency",
        F.array_join(F.transform("a.line_items", lambda i: F.concat_ws("/", i["item_name"], i["quantity"], i["total_price"], i["unit_price"])), ",").alias("line_items")),
    ("merge_inputs",), "SELECT job_id, " + ", ".join(f"coalesce(corrections['{o}'], '') AS {i}" for i, o in API_FIELDS) + """,
    coalesce(corrections['currency'], 'USD') AS currency,
    array_to_string(list_transform(cost_items, lambda i: coalesce(i['item'], '') || '/' || coalesce(i['quantity'], '1') || '/' ||
      coalesce(i['total'], '') || '/' || coalesce(i['unit_price'], '')), ',') AS line_items FROM merge_inputs""")
add("p12_job_status_view", lambda t: lifecycle.job_status_view(t.jobs), ("jobs",), """
    SELECT job_id, status, original_filename, template_correspondence,
      CASE WHEN status = 'completed' THEN extracted_data END AS extracted_data,
      CASE WHEN status = 'completed' THEN user_corrections END AS user_corrections,
      CASE WHEN status = 'failed' THEN error_message END AS error_message FROM jobs""")
add("p13_receipt_listing", lambda t: receipts.receipt_listing(t.receipts, t.users, t.templates), ("receipts", "users", "templates"), f"""
    SELECT receipt_id, r.merchant_name AS merchant, coalesce({d_minute('transaction_time')}, 'N/A') AS date,
      CAST(total_amount AS VARCHAR) || ' ' || currency AS amount, status, e.email AS employee_email, a.email AS approver_email,
      t.merchant_name AS template_merchant FROM receipts r LEFT JOIN users e ON e.user_id = employee
    LEFT JOIN users a ON a.user_id = approver LEFT JOIN templates t ON t.template_id = template_used""")
BANDS = "CASE WHEN {v} >= 80 THEN 'high' WHEN {v} >= 50 THEN 'medium' ELSE 'low' END"
add("p14_job_listing", lambda t: lifecycle.job_listing(t.jobs, t.templates), ("jobs", "templates"), f"""
    SELECT job_id, user_id, status, original_filename AS filename, CASE WHEN coalesce(template_correspondence, 0) = 0 THEN 'N/A'
      ELSE {BANDS.format(v='template_correspondence * 100')} END AS confidence, {d_minute('j.created_at')} AS created,
      merchant_name AS template_merchant FROM jobs j LEFT JOIN templates t ON t.template_id = template_used""")
add("p15_template_listing", lambda t: lifecycle.template_listing(t.templates), ("templates",), f"""
    SELECT template_id, merchant_name AS merchant, usage_count,
      CASE WHEN success_rate = 0 THEN '0%' ELSE printf('%.2f%%', success_rate) END AS success_rate,
      CASE WHEN success_rate = 0 THEN 'none' ELSE {BANDS.format(v='success_rate')} END AS band,
      CASE WHEN is_archived THEN 'Archived' ELSE 'Active' END AS status, {d_minute('last_used_at')} AS last_used FROM templates""")
add("p16_account_listing", lambda t: accounts.account_listing(t.users, t.profiles, t.settings), ("users", "profiles", "settings"), """
    SELECT p.profile_id, p.employee_id, p.first_name || ' ' || p.last_name AS name, p.department, p.position, u.email,
      m.first_name || ' ' || m.last_name AS manager_name, coalesce(s.default_currency, 'GBP') AS default_currency,
      monthly_expense_limit, a.email AS approver_email
    FROM profiles p LEFT JOIN profiles m ON m.profile_id = p.manager LEFT JOIN users u ON u.user_id = p.user_id
    LEFT JOIN settings s ON s.user_id = u.user_id LEFT JOIN users a ON a.user_id = s.expense_approver""")
add("p18_revoked_token_browse", lambda t: accounts.revoked_token_browse(t.tokens, "day", "1", "2024-01-03", "2024-01-25").select(
        second("period").alias("period"), "n"), ("tokens",), f"""
    SELECT {d_second("date_trunc('day', blacklisted_at)")} AS period, count(*) AS n FROM tokens
    WHERE (contains(token_jti, '1') OR contains(user_id, '1')) AND blacklisted_at >= '2024-01-03' AND expires_at <= '2024-01-25' GROUP BY 1""")

# --- joins ---------------------------------------------------------------------------

add("j1_receipt_employee", lambda t: receipts.join_user(t.receipts, t.users, "employee", "email").select("receipt_id", "employee", "email"),
    ("receipts", "users"), "SELECT receipt_id, employee, email FROM receipts LEFT JOIN users ON user_id = employee")
add("j2_receipt_template", lambda t: receipts.join_template(t.receipts, t.templates).select("receipt_id", "template_used", "template_merchant"),
    ("receipts", "templates"), """SELECT receipt_id, template_used, t.merchant_name AS template_merchant
    FROM receipts r LEFT JOIN templates t ON t.template_id = template_used""")
add("j3_receipt_approver", lambda t: receipts.join_user(t.receipts, t.users, "approver", "email").select("receipt_id", text("approver"), "email"),
    ("receipts", "users"), "SELECT receipt_id, CAST(approver AS VARCHAR) AS approver, email FROM receipts LEFT JOIN users ON user_id = approver")
add("j4_user_profile", lambda t: accounts.user_profile(t.users, t.profiles).select("user_id", "email", "employee_id", "department"),
    ("users", "profiles"), """SELECT u.user_id, email, employee_id, department FROM users u LEFT JOIN (
      SELECT * FROM profiles QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY profile_id) = 1) p ON p.user_id = u.user_id""")
add("j5_profile_manager", lambda t: accounts.profile_manager(t.profiles).select("profile_id", text("manager"), "manager_employee_id", "manager_name"),
    ("profiles",), """SELECT p.profile_id, CAST(p.manager AS VARCHAR) AS manager, m.employee_id AS manager_employee_id,
      m.first_name || ' ' || m.last_name AS manager_name FROM profiles p LEFT JOIN profiles m ON m.profile_id = p.manager""")
add("j6_user_settings", lambda t: accounts.user_settings(t.users, t.settings).select("user_id", "default_currency", "monthly_expense_limit", "approver_email"),
    ("users", "settings"), """SELECT u.user_id, coalesce(default_currency, 'GBP') AS default_currency, monthly_expense_limit, a.email AS approver_email
    FROM users u LEFT JOIN settings s ON s.user_id = u.user_id LEFT JOIN users a ON a.user_id = s.expense_approver""")
add("j7_job_template", lambda t: receipts.join_template(t.jobs, t.templates).select("job_id", "template_used", "template_merchant"),
    ("jobs", "templates"), """SELECT job_id, template_used, merchant_name AS template_merchant
    FROM jobs LEFT JOIN templates ON template_id = template_used""")
add("j8_job_files", lambda t: lifecycle.job_files(t.jobs, readers.encode_payload(t.landing_files).withColumn("content", F.col("file"))).select(
        "job_id", "path", F.col("content").alias("file")), ("jobs", "landing_files"), """
    SELECT j.job_id, path, base64(encode(content)) AS file FROM jobs j LEFT JOIN landing_files f ON f.job_id = j.job_id""")
add("j9_orphan_files", lambda t: lifecycle.orphan_files(t.landing_files, t.jobs).select("job_id", "path"), ("jobs", "landing_files"), """
    SELECT job_id, path FROM landing_files f WHERE NOT EXISTS (
      SELECT 1 FROM jobs j WHERE j.job_id = f.job_id AND j.status NOT IN ('confirmed', 'discarded'))""")
add("j10_delete_rules", lambda t: accounts.nullify_missing(
        accounts.cascade_delete(t.receipts, t.users.where("is_active"), "employee", "user_id"),
        t.users.where("is_active"), "approver", "user_id").select("receipt_id", "employee", text("approver")), ("receipts", "users"), """
    SELECT receipt_id, employee, CASE WHEN a.user_id IS NOT NULL THEN CAST(approver AS VARCHAR) END AS approver FROM receipts
    LEFT JOIN (SELECT * FROM users WHERE is_active) a ON a.user_id = approver
    WHERE employee IN (SELECT user_id FROM users WHERE is_active)""")
add("j12_drop_revoked", lambda t: accounts.drop_revoked(
        t.events.select("event_id", F.concat(F.lit("jti-"), F.col("event_id").cast("string")).alias("token_jti")), t.tokens),
    ("tokens",), """SELECT event_id, 'jti-' || CAST(event_id AS VARCHAR) AS token_jti FROM events
    WHERE 'jti-' || CAST(event_id AS VARCHAR) NOT IN (SELECT token_jti FROM tokens)""")
add("j13_unique_insert", lambda t: accounts.unique_insert(
        t.profiles.where("department = 'BUILDING'"), t.profiles.where("department <> 'BUILDING'"), "employee_id", "profile_id").select(
        "profile_id", "employee_id", "accepted"), ("profiles",), """
    SELECT profile_id, employee_id, row_number() OVER (PARTITION BY employee_id ORDER BY profile_id) = 1 AND employee_id NOT IN (
      SELECT employee_id FROM profiles WHERE department = 'BUILDING') AS accepted FROM profiles WHERE department <> 'BUILDING'""")
add("j14_fk_valid", lambda t: accounts.fk_valid(t.settings, t.users, "expense_approver", "user_id").select(
        "user_id", text("expense_approver"), "is_valid"), ("settings", "users"), """
    SELECT s.user_id, CAST(expense_approver AS VARCHAR) AS expense_approver, expense_approver IS NULL OR u.user_id IS NOT NULL AS is_valid
    FROM settings s LEFT JOIN users u ON u.user_id = expense_approver""")
add("j16_merge_with_precedence", lambda t: t.merge_inputs.select("job_id", F.explode(receipts.merge_with_precedence(
        F.col("extracted"), F.col("descriptions"), F.col("corrections"))).alias("field", "value")), ("merge_inputs",), """
    , long AS (SELECT job_id, 1 AS rank, unnest(map_entries(extracted)) AS e FROM merge_inputs
      UNION ALL SELECT job_id, 2, unnest(map_entries(descriptions)) FROM merge_inputs
      UNION ALL SELECT job_id, 3, unnest(map_entries(corrections)) FROM merge_inputs)
    SELECT job_id, e.key AS field, arg_max(e.value, rank) AS value FROM long GROUP BY 1, 2""")

# --- orders ----------------------------------------------------------------------------

add("o1_default_order", lambda t: receipts.default_order(t.receipts, "transaction_time", "receipt_id").select(
        "receipt_id", second("transaction_time").alias("at")), ("receipts",),
    f"SELECT receipt_id, {d_second('transaction_time')} AS at FROM receipts ORDER BY transaction_time DESC NULLS LAST, receipt_id")
add("o2_limit_n", lambda t: receipts.limit_n(receipts.default_order(t.receipts, "transaction_time", "receipt_id"), "100").select(
        "receipt_id", second("transaction_time").alias("at")), ("receipts",),
    f"SELECT receipt_id, {d_second('transaction_time')} AS at FROM receipts ORDER BY transaction_time DESC NULLS LAST, receipt_id LIMIT 100")

# --- money, dates, items ------------------------------------------------------------------

D_TIME = """CASE WHEN coalesce(s, '') = '' THEN TIMESTAMP '2024-03-01 08:30:00' ELSE coalesce(try_strptime(s, '%Y-%m-%d'),
    try_strptime(s, '%d/%m/%Y'), try_strptime(s, '%m/%d/%Y'), try_strptime(s, '%Y-%m-%dT%H:%M:%S'), try_strptime(s, '%Y-%m-%d %H:%M:%S')) END"""
add("m1_parse_transaction_time", lambda t: t.date_strings.select("id", "s", second(
        ledger.parse_transaction_time(F.col("s"), now("2024-03-01 08:30:00"))).alias("at")), ("date_strings",),
    f"SELECT id, s, {d_second(D_TIME)} AS at FROM date_strings")
add("m2_to_money", lambda t: t.corrections.select("correction_id", "field", "corrected", ledger.to_money(
        F.regexp_extract(F.coalesce("extracted", F.lit("")), r"(\S*)$", 1)).cast("string").alias("amount"),
        ledger.is_bad_money(F.col("corrected")).alias("quarantine")), ("corrections",), """
    SELECT correction_id, field, corrected, CASE WHEN extracted IS NULL THEN '0.00'
      ELSE CAST(try_cast(regexp_extract(extracted, '(\\S*)$', 1) AS DECIMAL(10,2)) AS VARCHAR) END AS amount,
      corrected <> '' AND try_cast(corrected AS DECIMAL(10,2)) IS NULL AS quarantine FROM corrections""")
add("m3_normalise_items", lambda t: t.merge_inputs.select("job_id", F.posexplode(ledger.normalise_items(F.col("cost_items"))).alias("pos", "i")).select(
        "job_id", "pos", "i.item_name", *[F.col(f"i.{c}").cast("string").alias(c) for c in ("unit_price", "quantity", "total_price")]),
    ("merge_inputs",), """
    SELECT job_id, CAST(pos - 1 AS INT) AS pos, coalesce(i['item_name'], 'Unknown Item') AS item_name,
      CAST(CAST(coalesce(i['unit_price'], '0.00') AS DECIMAL(10,2)) AS VARCHAR) AS unit_price,
      CAST(CAST(coalesce(i['quantity'], '1') AS DECIMAL(10,2)) AS VARCHAR) AS quantity,
      CAST(CAST(coalesce(i['total_price'], i['total'], '0.00') AS DECIMAL(10,2)) AS VARCHAR) AS total_price
    FROM (SELECT job_id, unnest(cost_items) AS i, generate_subscripts(cost_items, 1) AS pos FROM merge_inputs)""")


def plain_items(t):
    return t.item_lines.select("l_orderkey", "l_linenumber", "l_partkey", F.col("total_price").cast("decimal(10,2)").alias("unit_price"),
                               F.col("quantity").cast("decimal(10,2)").alias("quantity"), F.when(
                                   F.col("l_partkey") % 3 == 0, F.col("total_price").cast("decimal(10,2)")).alias("total_price"))


add("m4_item_total", lambda t: receipts.fill_item_totals(plain_items(t)).select("l_orderkey", "l_linenumber", "l_partkey", text("total_price")),
    ("item_lines",), """SELECT l_orderkey, l_linenumber, l_partkey, CAST(CAST(CASE WHEN l_partkey % 3 = 0 THEN CAST(total_price AS DECIMAL(18,2))
      ELSE CAST(total_price AS DECIMAL(18,2)) * CAST(quantity AS INT) END AS DECIMAL(10,2)) AS VARCHAR) AS total_price FROM item_lines""")
def built_receipts(t):
    """Receipts of confirmed jobs, with what the job knows of file and template."""
    known = t.jobs.select("job_id", "template_used", "template_correspondence", F.concat(F.lit("file-"), "job_id").alias("file_ref"),
                          F.nullif(F.ltrim(ledger.file_extension(F.col("original_filename")), F.lit(".")), F.lit("")).alias("file_ext"))
    return receipts.build_receipts(t.merge_inputs.withColumn("items", F.col("corrected_items")).join(known, "job_id", "left"), now("2024-03-01 08:30:00"))


def landed_ledger(t):
    """A ledger after the same receipts were written twice, first half of them, with some of them double, and read back."""
    path = shared_dir(t.spark, "ledger")
    built = written(built_receipts(t), "built")
    writers.write_receipts(built.where("employee < '2'"), path)
    writers.write_receipts(built.unionByName(built.where("category = 'view'")), path)
    writers.write_receipts(built, path)
    return writers.read_ledger(t.spark, path)


D_JOB_EXT = "nullif(ltrim(regexp_extract(original_filename, '(\\.[^./]*)$', 1), '.'), '')"
add("k4_write_receipts", lambda t: landed_ledger(t).select(
        "job_id", "employee", "month", text("total_amount"), F.size("cost_items").alias("n_items"), "template_used", "file_ext"),
    ("merge_inputs", "jobs"), f"""
    , f AS (SELECT *, map_concat(extracted, descriptions, corrections) AS m FROM merge_inputs), g AS (SELECT *, m['transaction_time'] AS s FROM f)
    SELECT g.job_id, g.user_id AS employee, strftime({D_TIME}, '%Y-%m') AS month,
      CAST(CAST(coalesce(nullif(m['total_amount'], ''), '0.00') AS DECIMAL(10,2)) AS VARCHAR) AS total_amount, CAST(len(corrected_items) AS INT) AS n_items,
      template_used, {D_JOB_EXT} AS file_ext
    FROM g LEFT JOIN jobs j ON j.job_id = g.job_id""")
add("m5_build_receipts", lambda t: built_receipts(t).select(
        "job_id", "merchant_name", second("transaction_time").alias("at"), "category", "description", "currency", "employee", "status",
        text("total_amount"), text("tax_amount"), text("subtotal_amount"), F.size("cost_items").alias("n_items"), "quarantine",
        "template_used", "template_correspondence", "file_ref", "file_ext", second("upload_date").alias("uploaded"), second("updated_at").alias("updated")),
    ("merge_inputs", "jobs"), f"""
    , f AS (SELECT *, map_concat(extracted, descriptions, corrections) AS m FROM merge_inputs),
    g AS (SELECT *, m['transaction_time'] AS s FROM f)
    SELECT g.job_id, coalesce(m['merchant_name'], 'Unknown Merchant') AS merchant_name, {d_second(D_TIME)} AS at,
      coalesce(m['category'], 'Uncategorized') AS category, coalesce(m['description'], '') AS description,
      coalesce(m['currency'], 'GBP') AS currency, g.user_id AS employee, 'pending' AS status,
      CAST(CAST(coalesce(nullif(m['total_amount'], ''), '0.00') AS DECIMAL(10,2)) AS VARCHAR) AS total_amount,
      CAST(CAST(coalesce(nullif(m['tax_amount'], ''), '0.00') AS DECIMAL(10,2)) AS VARCHAR) AS tax_amount,
      CAST(CAST(coalesce(nullif(m['subtotal_amount'], ''), '0.00') AS DECIMAL(10,2)) AS VARCHAR) AS subtotal_amount,
      CAST(len(corrected_items) AS INT) AS n_items, false AS quarantine, template_used, template_correspondence,
      'file-' || g.job_id AS file_ref, {D_JOB_EXT} AS file_ext, '2024-03-01 08:30:00' AS uploaded, '2024-03-01 08:30:00' AS updated
    FROM g LEFT JOIN jobs j ON j.job_id = g.job_id""")
add("m6_explode_items", lambda t: receipts.explode_items(t.receipts).select("receipt_id", "pos", "item.item_name", "item.total_price"),
    ("receipts",), """SELECT receipt_id, CAST(pos - 1 AS INT) AS pos, i.item_name, i.total_price FROM (
      SELECT receipt_id, unnest(cost_items) AS i, generate_subscripts(cost_items, 1) AS pos FROM receipts)""")
add("m7_file_extension", lambda t: t.landing_files.select("path", ledger.file_extension(F.col("path")).alias("ext")), ("landing_files",),
    "SELECT path, regexp_extract(path, '(\\.[^./]*)$', 1) AS ext FROM landing_files")
add("m8_names", lambda t: accounts.with_clean_email(t.users).join(t.profiles, "user_id").select(
        "profile_id", "email", ledger.full_name(F.col("first_name"), F.col("last_name")).alias("full_name")), ("users", "profiles"), """
    SELECT profile_id, lower(email) AS email, first_name || ' ' || last_name AS full_name FROM users JOIN profiles USING (user_id)""")
add("e1_reconcile_total", lambda t: receipts.reconcile_total(t.receipts).select("receipt_id", text("items_total"), "reconciled"), ("receipts",), """
    SELECT receipt_id, CAST(CAST(list_sum(list_transform(cost_items, lambda i: CAST(i.total_price AS DECIMAL(20,2)))) AS DECIMAL(20,2)) AS VARCHAR) AS items_total,
      abs(total_amount - list_sum(list_transform(cost_items, lambda i: CAST(i.total_price AS DECIMAL(20,2))))) <= 0.01 AS reconciled FROM receipts""")
KEYWORDS = " ".join(f"WHEN regexp_matches(lower(ocr_text), '{'|'.join(w)}') THEN '{n}'" for n, w in fixed.CATEGORY_KEYWORDS)
add("e3_categorise", lambda t: t.noisy_receipts.select("receipt_id", receipts.categorise(F.col("ocr_text")).alias("category")), ("noisy_receipts",),
    f"SELECT receipt_id, CASE {KEYWORDS} ELSE 'OTHER' END AS category FROM noisy_receipts")
PAYMENTS = ", ".join(f"CASE WHEN regexp_matches(ocr_text, '(?i)\\b(?:{w})\\b') THEN '{n}' END" for n, w in fixed.PAYMENT_NAMES)
add("e4_payment_methods", lambda t: t.noisy_receipts.select("receipt_id", listed(receipts.payment_methods(F.col("ocr_text"))).alias("methods")),
    ("noisy_receipts",), f"SELECT receipt_id, array_to_string(list_filter([{PAYMENTS}], lambda x: x IS NOT NULL), ',') AS methods FROM noisy_receipts")
