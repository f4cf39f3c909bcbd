"""Column names of the transaction model."""

# The raw column names of the online-retail layout, and the renaming
# applied to uploaded files.
ONLINE_RETAIL_COLUMNS = (
    "Invoice",
    "StockCode",
    "Description",
    "Quantity",
    "InvoiceDate",
    "Price",
    "Customer ID",
    "Country",
)
UPLOAD_NAMES = {
    "Customer ID": "customer_id",
    "Price": "total_spend",
    "InvoiceDate": "order_date",
    "Invoice": "order_id",
    "Country": "location",
}

# Columns by how they are read.
TIME_COLUMNS = ("order_date", "last_purchase_date")
FLAG_COLUMNS = ("visited", "added_to_cart", "purchased", "churn")
AMOUNT_COLUMNS = ("recency_days", "total_spend", "price", "quantity", "discount")
FUNNEL_STAGES = ("visited", "added_to_cart", "purchased")
CATEGORY_COLUMNS = ("channel", "device", "location", "payment_method", "category")
DEFAULTED_COLUMNS = (
    "visited",
    "added_to_cart",
    "purchased",
    "price",
    "quantity",
    "discount",
    "total_spend",
)
