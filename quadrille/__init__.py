"""quadrille: square-marker analytics and corpus preparation on Spark."""
