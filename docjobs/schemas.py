"""Schemas of the nested records."""

VENDOR = "struct<name:string,phone:string,address:string,website:string>"
DETAILS = "struct<number:string,date:string,due_date:string,po_number:string>"
FINANCIALS = "struct<total_amount:double,subtotal:double,tax:double,credits:double,balance_due:double>"
LINE_ITEMS = "array<struct<description:string,quantity:double,unit_price:double,total_price:double,product_code:string>>"
SHIFT = "struct<total_sales:double,fuel_sales:double,merch_sales:double,cash_drop:double>"
SHIFT_FIELDS = ("total_sales", "fuel_sales", "merch_sales", "cash_drop")

INVOICE = f"struct<doc_type:string,vendor:{VENDOR},invoice_details:{DETAILS},financials:{FINANCIALS},line_items:{LINE_ITEMS},shift_report_details:{SHIFT}>"
EXTRACTED = f"struct<confidence:int,data:{INVOICE}>"
PAGE_RESULT = f"batch_id bigint, pos int, filename string, model_used string, data_json string, extracted {EXTRACTED}"

_PARTY = "struct<name:string,address:string>"
CLAIMS = f"struct<party_a:{_PARTY},party_b:{_PARTY},expected_changes:array<struct<expected_text:string,clause:string>>>"
LOG_RECORD = f"metadata struct<filename:string,timestamp:string,model:string,duration_seconds:double,confidence_score:double>, extraction {INVOICE}"
ANALYSIS = "struct<Summary:array<string>,Title:string,Author:array<string>,DateCreated:string,LastModifiedDate:string,Publisher:string,Language:string,PageCount:string,SentimentTone:string>"
