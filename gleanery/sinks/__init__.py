"""Writers: delimited text, JSON, workbooks and archives."""
