"""Registered queries: name -> callable(spark, folder), with oracle SQL where SQL can express them."""
