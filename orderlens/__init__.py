"""orderlens: order-risk, classifier-evaluation and support-routing analytics on Spark."""
