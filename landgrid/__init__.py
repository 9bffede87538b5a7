"""Location-aware valuation analytics and corpus preparation on Apache Spark."""
