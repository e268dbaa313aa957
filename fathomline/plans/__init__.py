"""fathomline.plans"""
