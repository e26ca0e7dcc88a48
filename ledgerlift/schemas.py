"""Schemas of the ledger tables as DDL strings, which every reader accepts."""


CONFIG_EXTRACTOR = ("struct<expected_present:boolean,patterns:array<string>,line:int,"
                    "offset_from_last_item:int,is_fuzzy_haystack:boolean>")
CONFIG_ITEM_PATTERN = "struct<pattern:string,groups:map<string,int>>"
ITEM = "struct<item_name:string,quantity:string,total_price:string,unit_price:string>"
COST_ITEM = ("struct<item_name:string,unit_price:decimal(10,2),quantity:decimal(10,2),total_price:decimal(10,2)>")

CURRENCY = "struct<iso_code:string,symbol:string>"
RECENT_USAGE = "struct<last_30_days:int,total_merchant_uses:int,usage_percentage:double>"

RECEIPT = f"""
    receipt_id string, merchant_name string, transaction_time timestamp, merchant_address string,
    reference_number string, tax_amount decimal(10,2), category string, description string,
    total_amount decimal(10,2), subtotal_amount decimal(10,2), currency string,
    cost_items array<{COST_ITEM}>, template_used string, employee string, status string, approver string,
    upload_date timestamp, file_ref string, file_ext string, template_correspondence double,
    latitude double, longitude double, location_name string, created_at timestamp, updated_at timestamp"""

#: Receipts as confirmed jobs leave them, in folders by month.
LEDGER = f"""
    job_id string, merchant_name string, transaction_time timestamp, merchant_address string, reference_number string,
    category string, description string, currency string, status string, employee string, total_amount decimal(10,2),
    tax_amount decimal(10,2), subtotal_amount decimal(10,2), cost_items array<{COST_ITEM}>, template_used string,
    template_correspondence double, file_ref string, file_ext string, upload_date timestamp, updated_at timestamp,
    quarantine boolean, month string"""

TEMPLATE = f"""
    template_id string, created_at timestamp, updated_at timestamp, last_used_at timestamp, usage_count int,
    success_rate double, override_rate double, avg_edit_distance double, is_archived boolean,
    archived_at timestamp, metadata map<string,string>, merchant_name string, currency_info {CURRENCY},
    field_extractors map<string,{CONFIG_EXTRACTOR}>, has_line_items boolean, line_items_start_line int,
    item_patterns array<{CONFIG_ITEM_PATTERN}>, field_accuracy map<string,double>,
    field_edit_distances map<string,double>, recent_usage {RECENT_USAGE}"""

JOB = """
    job_id string, user_id string, status string, original_filename string, file_type string, file_ref string,
    metadata map<string,string>, extracted_data string, user_corrections string, error_message string,
    template_correspondence double, template_used string, created_at timestamp, updated_at timestamp,
    processing_started timestamp, processing_completed timestamp"""

USER = """
    user_id string, email string, is_active boolean, is_staff boolean, is_superuser boolean,
    date_joined timestamp, last_login timestamp, groups array<string>, user_permissions array<string>"""

PROFILE = """
    profile_id string, user_id string, employee_id string, first_name string, last_name string,
    department string, position string, manager string"""

SETTINGS = """
    user_id string, default_currency string, expense_approver string, monthly_expense_limit decimal(10,2)"""

REVOKED_TOKEN = """
    token_jti string, user_id string, blacklisted_at timestamp, expires_at timestamp"""
