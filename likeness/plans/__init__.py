"""Plans of names and destinations (pure), and carrying them out (on the driver)."""
