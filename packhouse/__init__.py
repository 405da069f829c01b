"""Packhouse: order-fulfilment operations and order-risk scoring on Spark DataFrames."""
