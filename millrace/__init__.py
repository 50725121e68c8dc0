"""Analytics on PySpark: calibration of scores against outcomes, and text preparation."""
