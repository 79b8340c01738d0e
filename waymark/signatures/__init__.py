"""Signature tables. They are data: pass longer lists to extend them."""
