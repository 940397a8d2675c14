"""duskline: privacy-risk analytics and corpus preparation on PySpark."""
