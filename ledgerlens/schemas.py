"""Column names and typed schemas of the ERP extracts.

The analytics address columns through these names.  Every identifier is a
string (leading zeros survive), money is ``decimal(18,2)`` so sums are
exact and independent of partition order, dates are ``DateType``.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ERP column titles used by the audit analytics.
COMPANY = "Company_Code"
COMPANY_NAME = "Name_of_Company_Code_or_Company"
VENDOR = "Account_Number_of_Vendor_or_Creditor"
VENDOR_NAME = "Vendor_Name"
DOC = "Accounting_Document_Number"
LINE = "Number_of_Line_Item_Within_Accounting_Document"
DOC_TYPE = "Document_Type"
DOC_DATE = "Document_Date_in_Document"
REF = "Reference_Document_Number"
IND = "Debit_Credit_Indicator"
AMT_LOC = "Amount_in_Local_Currency"
AMT_DOC = "Amount_in_Document_Currency"
CURRENCY = "Currency_Key"
DOC_CUR = "Document_Currency_Key"
LOC_CUR = "Local_Currency_Key"
PO_VENDOR = "Vendor_Account_Number"
PO_NUM = "Purchasing_Document_Number"
PO_ITEM = "Item_Number_of_Purchasing_Document"
CUST = "Customer_Number"
AREA = "Credit_Control_Area"
LIMIT = "Customer_s_credit_limit"

# Document types that are payments, not invoices.
PAYMENT_DOC_TYPES = ("ZP", "KZ")
# Debit / credit indicator codes.
DEBIT = "S"
CREDIT = "H"
# Age buckets of open customer items.
BUCKET_60_90 = "60-90"
BUCKET_90_120 = "90-120"
BUCKET_OVER_120 = "> 120"
BUCKET_UNDER_60 = "< 60"
BUCKET_NOT_OUTSTANDING = "not outstanding"
OVERDUE_BUCKETS = (BUCKET_60_90, BUCKET_90_120, BUCKET_OVER_120)
# Payment-mix labels and credit-limit labels.
BOTH_SUNDRY = "both_sundry"
ONLY_SUNDRY = "only_sundry"
BOTH_PO = "both_po"
ONLY_PO = "only_po"
ABOVE_LIMIT = "above limit"
BELOW_LIMIT = "below limit"
NO_LIMIT = "no limit"

MONEY = T.DecimalType(18, 2)
# Sums of amounts: the type Spark gives them.
TOTAL = T.DecimalType(28, 2)

# Output column lists of the audit reports.
# Column order of the report.
TASK1_COLUMNS = [
    COMPANY,
    COMPANY_NAME,
    VENDOR,
    AMT_LOC,
    LOC_CUR,
    AMT_DOC,
    DOC_CUR,
    DOC,
    DOC_DATE,
    DOC_TYPE,
    REF,
]
TASK3_COLUMNS = TASK1_COLUMNS
# Column order of the report.
TASK4_COLUMNS = [
    COMPANY,
    COMPANY_NAME,
    VENDOR,
    IND,
    AMT_LOC,
    LOC_CUR,
    AMT_DOC,
    DOC_CUR,
    DOC,
    DOC_DATE,
    REF,
]
# Column order of the report.
SINGLE_DOC_COLUMNS = [c for c in TASK4_COLUMNS if c != COMPANY_NAME]
# Column order of the report.
TASK5_COLUMNS = [
    CUST,
    COMPANY,
    COMPANY_NAME,
    "Total_Amount_Local_Currency",
    LOC_CUR,
    LIMIT,
    "Local_Amount_60-90_Days",
    "Local_Amount_90-120_Days",
    "Local_Amount_>120_Days",
]


# Raw CSV schemas: the columns the analytics name.  Real extracts carry more
# columns; readers select by header name, so extra columns are ignored.
BSAK_FIELDS = {
    COMPANY: T.StringType(),
    VENDOR: T.StringType(),
    DOC: T.StringType(),
    LINE: T.IntegerType(),
    DOC_TYPE: T.StringType(),
    DOC_DATE: T.StringType(),
    REF: T.StringType(),
    IND: T.StringType(),
    AMT_LOC: MONEY,
    AMT_DOC: MONEY,
    CURRENCY: T.StringType(),
}
T001_FIELDS = {COMPANY: T.StringType(), COMPANY_NAME: T.StringType(), CURRENCY: T.StringType()}
LFA1_FIELDS = {VENDOR: T.StringType()}
RSEG_FIELDS = {PO_NUM: T.StringType(), PO_ITEM: T.StringType()}
EKBE_FIELDS = {
    PO_NUM: T.StringType(),
    PO_ITEM: T.StringType(),
    PO_VENDOR: T.StringType(),
    REF: T.StringType(),
}
BSID_FIELDS = {
    COMPANY: T.StringType(),
    CUST: T.StringType(),
    REF: T.StringType(),
    IND: T.StringType(),
    AMT_LOC: MONEY,
    DOC_DATE: T.StringType(),
    CURRENCY: T.StringType(),
}
KNKK_FIELDS = {CUST: T.StringType(), AREA: T.StringType(), LIMIT: MONEY}

# The PO-line extract is repaired to this many fields.
EKPO_FIELD_COUNT = 29
