"""Analytics of who infected whom: transmission scenarios, compatibility scores, outbreak simulation, on Spark."""
