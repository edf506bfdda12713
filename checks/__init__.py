"""One query per operator, and the SQL each must agree with."""
