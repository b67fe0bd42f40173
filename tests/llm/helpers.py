def words(rnd, n, prefix="w", most=4000):
    return " ".join(f"{prefix}{rnd.randrange(most)}" for _ in range(n))
