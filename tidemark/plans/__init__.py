"""Delivery policies, rename plans and the registered queries."""
