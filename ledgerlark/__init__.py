"""Point-in-time corporate credit-risk analytics on PySpark."""
