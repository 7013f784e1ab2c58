"""The operators bound to the driver's tables; importing a module registers its queries."""
